"""Queries: sources, preparation, sampling, counts (A1/A2, A5, B*, C1, D*, E*, F1-F4, K4 folds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import distribution, explore, prepare, sampling
from ..session import scratch_path
from ..sources import files, schemas
from ..sources.tables import AS_OF, TXN_SQL, load_txn, table, txn_view
from .registry import query

W = f"WITH txn AS ({TXN_SQL})"

# Fixed sampling parameters: keep every fraud, one in ten of the rest, seed 123.
SAMPLE_FRACTIONS = {0: 0.10, 1: 1.0}
SAMPLE_SEED = 123
FOLDS = 3
FOLD_SEED = 7

PREPARED_COLS = ["txn_id", "amt", "merchant", "category", "gender", "job", "city_pop", "lat", "long",
                 "merch_lat", "merch_long", "portion", "is_fraud", "age", "trans_month", "trans_hour",
                 "trans_day_of_week", "trans_day_of_month", "trans_day_of_year", "distance_km"]


def prepared_txn(spark, sf_dir):
    txn = load_txn(spark, sf_dir)
    return prepare.prepare(txn, as_of=AS_OF, dob="dob", ts="trans_ts", drop=[])


_AGE_SQL = f"CAST(trunc(datediff('day', dob, DATE '{AS_OF}') / 365) AS INTEGER)"
_DIST_SQL = """round(6371.0 * (2 * atan2(sqrt(least(greatest(
      pow(sin((radians(merch_lat) - radians(lat)) / 2), 2)
      + cos(radians(lat)) * cos(radians(merch_lat)) * pow(sin((radians(merch_long) - radians(long)) / 2), 2),
      0.0), 1.0)), sqrt(1 - least(greatest(
      pow(sin((radians(merch_lat) - radians(lat)) / 2), 2)
      + cos(radians(lat)) * cos(radians(merch_lat)) * pow(sin((radians(merch_long) - radians(long)) / 2), 2),
      0.0), 1.0)))), 6)"""
_PARTS_SQL = """CAST(month(trans_ts) AS INTEGER) AS trans_month, CAST(hour(trans_ts) AS INTEGER) AS trans_hour,
       CAST(dayofweek(trans_ts) + 1 AS INTEGER) AS trans_day_of_week,
       CAST(day(trans_ts) AS INTEGER) AS trans_day_of_month,
       CAST(dayofyear(trans_ts) AS INTEGER) AS trans_day_of_year"""


@query("prepared", f"""{W}
SELECT txn_id, amt, merchant, category, gender, job, city_pop, lat, long, merch_lat, merch_long,
       portion, is_fraud, {_AGE_SQL} AS age, {_PARTS_SQL}, {_DIST_SQL} AS distance_km
FROM txn""")
def q_prepared(spark, sf_dir):
    df = prepared_txn(spark, sf_dir)
    return df.select(*PREPARED_COLS[:-1], F.round("distance_km", 6).alias("distance_km"))


@query("distance_km", f"{W} SELECT txn_id, {_DIST_SQL} AS distance_km FROM txn")
def q_distance(spark, sf_dir):
    txn = load_txn(spark, sf_dir)
    d = scalar.haversine_km("long", "lat", "merch_long", "merch_lat")
    return txn.select("txn_id", F.round(d, 6).alias("distance_km"))


@query("age_years", f"""SELECT o_orderkey, {_AGE_SQL.replace('dob', 'CAST(o_orderdate AS DATE)')} AS age
FROM orders""")
def q_age(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", scalar.age_years(F.to_date("o_orderdate"), AS_OF).alias("age"))


@query("calendar_parts", f"{W} SELECT txn_id, {_PARTS_SQL} FROM txn")
def q_calendar(spark, sf_dir):
    txn = load_txn(spark, sf_dir)
    return txn.select("txn_id", *[c.alias(n) for n, c in scalar.calendar_parts("trans_ts").items()])


@query("tag_union", f"""{W}
SELECT txn_id, amt, category, is_fraud, 'train' AS portion FROM txn WHERE txn_id % 10 < 7
UNION ALL
SELECT txn_id, amt, category, is_fraud, 'test' AS portion FROM txn WHERE txn_id % 10 >= 7""")
def q_tag_union(spark, sf_dir):
    txn = load_txn(spark, sf_dir).select("txn_id", "amt", "category", "is_fraud")
    train = txn.where(F.col("txn_id") % 10 < 7)
    test = txn.where(F.col("txn_id") % 10 >= 7)
    return prepare.tag_union({"train": train, "test": test})


@query("split_counts", f"{W} SELECT portion, count(*) AS count FROM txn GROUP BY portion")
def q_split_counts(spark, sf_dir):
    train, test = prepare.split_portions(load_txn(spark, sf_dir))
    return distribution.group_count(train.unionAll(test), "portion")


@query("class_distribution", f"""{W}
SELECT is_fraud, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 9) AS proportion
FROM txn GROUP BY is_fraud""")
def q_class_distribution(spark, sf_dir):
    return distribution.class_distribution(load_txn(spark, sf_dir), "is_fraud")


VALUE_COUNT_COLS = ["category", "gender", "job", "merchant"]


@query("value_counts", f"""{W}
SELECT "column", value, count(*) AS count FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM txn" for c in VALUE_COUNT_COLS)}
) WHERE value IS NOT NULL GROUP BY "column", value""")
def q_value_counts(spark, sf_dir):
    return distribution.value_counts(load_txn(spark, sf_dir), VALUE_COUNT_COLS)


_FRACTION_SQL = " ".join(f"WHEN is_fraud = {k} THEN {float(v)}" for k, v in SAMPLE_FRACTIONS.items())


@query("strat_sample", f"""{W}
SELECT txn_id, is_fraud FROM txn
WHERE {scalar.hash01_sql('txn_id', SAMPLE_SEED)} < (CASE {_FRACTION_SQL} END)""")
def q_strat_sample(spark, sf_dir):
    txn = load_txn(spark, sf_dir)
    return sampling.stratified_sample(txn, "is_fraud", SAMPLE_FRACTIONS, SAMPLE_SEED, key="txn_id") \
        .select("txn_id", "is_fraud")


@query("strat_sample_native")
def q_strat_sample_native(spark, sf_dir):
    txn = load_txn(spark, sf_dir)
    return sampling.sample_by_native(txn, "is_fraud", SAMPLE_FRACTIONS, SAMPLE_SEED).select("txn_id", "is_fraud")


@query("strat_sample_native_share", f"""{W} SELECT is_fraud, count(*) AS rows, TRUE AS within FROM txn GROUP BY is_fraud""")
def q_strat_sample_native_share(spark, sf_dir):
    """What Spark's own sampler keeps depends on the layout, but not its share: a class of fraction 1 stays
    whole, another one is within five standard errors of its fraction."""
    txn = load_txn(spark, sf_dir)
    kept = sampling.sample_by_native(txn, "is_fraud", SAMPLE_FRACTIONS, SAMPLE_SEED).groupBy("is_fraud").agg(F.count(F.lit(1)).alias("kept"))
    both = distribution.group_count(txn, "is_fraud").join(kept, "is_fraud", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    share = F.when(F.col("is_fraud") == 1, F.lit(SAMPLE_FRACTIONS[1])).otherwise(F.lit(SAMPLE_FRACTIONS[0]))
    off = F.abs(F.col("kept") - share * F.col("count"))
    return both.select("is_fraud", F.col("count").alias("rows"), (off <= 5 * F.sqrt(F.col("count") * share * (1 - share))).alias("within"))


@query("fold_assign", f"""{W}
SELECT CAST(floor({scalar.hash01_sql('txn_id', FOLD_SEED)} * {FOLDS}) AS INTEGER) AS fold,
       count(*) AS count, CAST(sum(is_fraud) AS BIGINT) AS positives
FROM txn WHERE portion = 'train' GROUP BY 1""")
def q_fold_assign(spark, sf_dir):
    train = load_txn(spark, sf_dir).where(F.col("portion") == "train")
    folded = sampling.assign_folds(train, FOLDS, FOLD_SEED, key="txn_id")
    return folded.groupBy("fold").agg(F.count(F.lit(1)).alias("count"),
                                      F.sum("is_fraud").cast("bigint").alias("positives"))


@query("fold_balanced", f"""{W}, c AS (SELECT is_fraud, count(*) AS n FROM txn WHERE portion = 'train' GROUP BY is_fraud)
SELECT CAST(fold AS INTEGER) AS fold, is_fraud, CAST((n + {FOLDS} - 1 - fold) // {FOLDS} AS BIGINT) AS count
FROM c, range({FOLDS}) AS f(fold)""")
def q_fold_balanced(spark, sf_dir):
    """Folds dealt round robin within the class: every fold has each class's rows to within one."""
    train = load_txn(spark, sf_dir).where(F.col("portion") == "train").select("txn_id", "is_fraud")
    folded = sampling.balanced_folds(train, FOLDS, FOLD_SEED, key="txn_id", label="is_fraud")
    return folded.groupBy("fold", "is_fraud").agg(F.count(F.lit(1)).alias("count"))


_TOP_SQL = {"merchant": "merchant", "txn_id": "txn_id", "euros": "CAST(floor(amt) AS BIGINT)", "cents": "CAST(floor(amt * 100) AS BIGINT)"}
TOP_N = 10


@query("top_values", f"""{W} SELECT "column", value, count FROM (
SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS r FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS \"column\", CAST({e} AS VARCHAR) AS value, count(*) AS count FROM txn GROUP BY ALL" for c, e in _TOP_SQL.items())}
) WHERE value IS NOT NULL) WHERE r <= {TOP_N}""")
def q_top_values(spark, sf_dir):
    """Most frequent values of a category, an identifier and two numbers, from bounded summaries."""
    txn = load_txn(spark, sf_dir).select("merchant", "txn_id", F.floor("amt").alias("euros"), F.floor(F.col("amt") * 100).alias("cents"))
    return distribution.top_values(txn, list(_TOP_SQL), TOP_N)


_CSV_COLS = ["txn_id", "trans_ts", "amt", "merchant", "category", "gender", "job", "city_pop", "dob",
             "lat", "long", "merch_lat", "merch_long", "portion", "is_fraud"]


@query("csv_roundtrip", f"{W} SELECT {', '.join(_CSV_COLS)} FROM txn")
def q_csv_roundtrip(spark, sf_dir):
    src = load_txn(spark, sf_dir).select(*_CSV_COLS)
    path = scratch_path(spark, "csv_roundtrip")
    files.write_csv(src, path)
    return files.read_csv(spark, path, schema=src.schema, timestamp_format=files.CSV_TIMESTAMP_FORMAT)


def raw_from_events(events):
    """Raw-transaction-shaped rows (dates as text, identifying columns) from ``events``, as the
    CSV files of the raw table hold them."""
    t = txn_view(events)
    return t.select(
        F.col("txn_id").cast("int").alias("_c0"),
        F.date_format("trans_ts", "yyyy-MM-dd HH:mm:ss").alias("trans_date_trans_time"),
        (F.col("txn_id") + 4000000000000000).alias("cc_num"), "merchant", "category", "amt",
        F.lit("first").alias("first"), F.lit("last").alias("last"), "gender", F.lit("street").alias("street"),
        F.concat(F.lit("city_"), (F.col("txn_id") % 7).cast("string")).alias("city"),
        F.lit("NC").alias("state"), F.lit(28654).alias("zip"), "lat", "long",
        F.col("city_pop").cast("int").alias("city_pop"), "job",
        F.date_format("dob", "yyyy-MM-dd").alias("dob"), F.col("txn_id").cast("string").alias("trans_num"),
        F.unix_timestamp(F.col("trans_ts").cast("timestamp")).alias("unix_time"), "merch_lat", "merch_long",
        "is_fraud", "portion")


_INGEST_COLS = ["portion", "merchant", "category", "amt", "gender", "city", "state", "city_pop", "job", "is_fraud",
                "age", "trans_month", "trans_hour", "trans_day_of_week", "trans_day_of_month", "trans_day_of_year"]


@query("csv_ingest", f"""{W} SELECT CAST(txn_id AS VARCHAR) AS trans_num, portion, merchant, category, amt, gender,
       concat('city_', CAST(txn_id % 7 AS VARCHAR)) AS city, 'NC' AS state, city_pop, job, is_fraud,
       {_AGE_SQL} AS age, {_PARTS_SQL}, {_DIST_SQL} AS distance_km FROM txn""")
def q_csv_ingest(spark, sf_dir):
    """The raw path: CSV files with ordinary timestamps, tagged and united by position, split,
    without the identifying columns, dates parsed."""
    raw = raw_from_events(table(spark, sf_dir, "events"))
    parts = {}
    for name in ("train", "test"):
        path = scratch_path(spark, f"raw_{name}")
        raw.where(F.col("portion") == name).drop("portion").write.option("header", True).csv(path)
        parts[name] = files.read_raw_transactions(spark, path)
    drop = [c for c in schemas.IDENTIFYING_COLUMNS if c != "trans_num"]
    united = prepare.tag_union(parts, by_position=True)
    prepared = prepare.prepare(united, as_of=AS_OF, drop=drop)
    train, test = prepare.split_portions(prepared)
    return train.union(test).select("trans_num", *_INGEST_COLS, F.round("distance_km", 6).alias("distance_km"))


@query("csv_unparsed", f"""{W} SELECT "column", CAST(0 AS BIGINT) AS count
FROM (VALUES ('txn_id'), ('trans_ts'), ('amt'), ('dob'), ('is_fraud')) AS t("column")""")
def q_csv_unparsed(spark, sf_dir):
    """Values of a typed CSV read that are text but do not parse: none, in the ordinary form."""
    src = load_txn(spark, sf_dir).select("txn_id", "trans_ts", "amt", "dob", "is_fraud")
    path = scratch_path(spark, "csv_unparsed")
    src.withColumn("trans_ts", F.date_format("trans_ts", "yyyy-MM-dd HH:mm:ss")).write.option("header", True).csv(path)
    return files.unparsed(spark, path, src.schema)


# What is done to a line of the file, by txn_id % 50.
_SPOILT = {1: "fields", 2: "fields", 3: "amt", 4: "trans_ts", 5: "trans_ts,amt"}
_CHECKED = ["txn_id", "trans_ts", "amt", "merchant", "is_fraud"]


def _spoilt_csv(spark, sf_dir) -> tuple[str, object]:
    """The transactions as a CSV file with short, long and mistyped lines, and its schema."""
    src = load_txn(spark, sf_dir).select(*_CHECKED)
    kind = F.col("txn_id") % 50
    ts = F.when(kind.isin(4, 5), F.lit("yesterday")).otherwise(F.date_format("trans_ts", "yyyy-MM-dd HH:mm:ss"))
    amt = F.when(kind.isin(3, 5), F.lit("12,50 EUR")).otherwise(F.col("amt").cast("string"))
    quoted = F.concat(F.lit('"'), amt, F.lit('"'))
    line = F.concat_ws(",", F.col("txn_id").cast("string"), ts, quoted, "merchant", F.when(kind != 1, F.col("is_fraud").cast("string")),
                       F.when(kind == 2, F.lit("more")))
    path = scratch_path(spark, "spoilt_csv")
    src.select(line.alias("value")).write.text(path)
    return path, src.schema


@query("csv_rejected", f"""{W} SELECT txn_id, CASE WHEN txn_id % 50 IN ({', '.join(map(str, _SPOILT))}) THEN 'rejected' ELSE 'typed' END AS output,
  CASE txn_id % 50 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _SPOILT.items())} END AS reason FROM txn""")
def q_csv_rejected(spark, sf_dir):
    """A file with short, long and mistyped lines: every line is a typed row or a rejected one, with the reason."""
    path, schema = _spoilt_csv(spark, sf_dir)
    typed, rejected = files.ingest_csv(spark, path, scratch_path(spark, "checked"), schema, header=False)
    return typed.select("txn_id", F.lit("typed").alias("output"), F.lit(None).cast("string").alias("reason")) \
        .unionByName(rejected.select(F.split("line", ",")[0].cast("long").alias("txn_id"), F.lit("rejected").alias("output"), "reason"))


@query("csv_unparsed_values", f"""{W} SELECT * FROM (VALUES ('txn_id', 0), ('merchant', 0), ('is_fraud', 0),
  ('trans_ts', (SELECT count(*) FROM txn WHERE txn_id % 50 IN (4, 5))), ('amt', (SELECT count(*) FROM txn WHERE txn_id % 50 IN (3, 5))))
AS t("column", count)""")
def q_csv_unparsed_values(spark, sf_dir):
    """Values that are text but do not parse, in a file that has some."""
    path, schema = _spoilt_csv(spark, sf_dir)
    return files.unparsed(spark, path, schema, header=False)


_PROFILED = {"txn_id": "bigint", "amt": "double", "merchant": "string", "job": "string", "is_fraud": "int", "dob": "date"}


@query("column_profile", f"""{W} SELECT * FROM ({' UNION ALL '.join(
    f"SELECT {i} AS position, '{c}' AS name, '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS nulls, CAST(0 AS BIGINT) AS nan, "
    + ("CAST(NULL AS DOUBLE)" if t in ("string", "date") else f"round(avg(CAST({c} AS DOUBLE)), 6)") + " AS mean, "
    + ("CAST(min(amt) AS DOUBLE)" if c == "amt" else "CAST(NULL AS DOUBLE)") + " AS amt_min, "
    + ("NULL" if c == "amt" else f"CAST(min({c}) AS VARCHAR)") + " AS min, "
    + ("NULL" if c == "amt" else f"CAST(max({c}) AS VARCHAR)") + " AS max, TRUE AS distinct_within, TRUE AS quartiles_within FROM txn"
    for i, (c, t) in enumerate(_PROFILED.items()))})""")
def q_column_profile(spark, sf_dir):
    """All columns in one aggregate. Counts, extremes and means are exact; the sketched distinct counts
    are within five standard errors of the counted ones and the quartiles within the sketch's rank error."""
    txn = load_txn(spark, sf_dir).select(*_PROFILED)
    profile = files.profile_columns(txn)
    counted = txn.agg(*[F.count_distinct(c).alias(c) for c in _PROFILED])
    exact = counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("_d")) for c in _PROFILED])))
    values = explore.numeric_long(txn, ["txn_id", "amt", "is_fraud"]).drop("class") \
        .join(F.broadcast(profile.select("name", "q1", "median", "q3")), F.col("column") == F.col("name"))   # one row a column
    probs, off = {"q1": 0.25, "median": 0.5, "q3": 0.75}, explore.rank_error()
    ranks = values.groupBy("name").agg(*[((F.count_if(F.col("x") < F.col(q)) / F.count("x") <= p + off)
                                          & (F.count_if(F.col("x") <= F.col(q)) / F.count("x") >= p - off)).alias(f"_{q}")
                                         for q, p in probs.items()]).select(F.col("name").alias("_n"), (F.col("_q1") & F.col("_median") & F.col("_q3")).alias("_ok"))
    number = F.col("name") == "amt"
    return profile.join(exact, F.col("name") == F.col("_c")).join(ranks, F.col("name") == F.col("_n"), "left").select(
        "position", "name", "dtype", "rows", "nulls", "nan", F.round("mean", 6).alias("mean"),
        F.when(number, F.col("min").cast("double")).alias("amt_min"), F.when(~number, F.col("min")).alias("min"), F.when(~number, F.col("max")).alias("max"),
        (F.abs(F.col("n_distinct") - F.col("_d")) <= F.greatest(F.lit(1.0), 5 * files.distinct_error() * F.col("_d"))).alias("distinct_within"),
        F.coalesce("_ok", F.lit(True)).alias("quartiles_within"))


@query("preview", f"{W} SELECT txn_id, merchant, amt, is_fraud FROM txn ORDER BY amt, txn_id LIMIT 20")
def q_preview(spark, sf_dir):
    """The first rows in order of amount and id: the same on any layout."""
    return files.preview(load_txn(spark, sf_dir).select("txn_id", "merchant", "amt", "is_fraud"), ["amt", "txn_id"])


_DTYPE_SQL = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  ELSE lower(column_type) END"""


@query("schema_profile", f"""
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS name, {_DTYPE_SQL} AS dtype,
       CASE WHEN column_name = 'is_fraud' THEN 'label'
            WHEN column_type = 'VARCHAR' THEN 'categorical'
            WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'other' END AS role,
       (SELECT count(*) FROM events) AS non_null
FROM (DESCRIBE {W} SELECT * FROM txn)""")
def q_schema_profile(spark, sf_dir):
    return files.profile_schema(load_txn(spark, sf_dir)).drop("nullable")
