"""Queries: feature stages (F5-F11) on the model input of the transaction view."""

from __future__ import annotations

import itertools

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ..operators import features, prepare
from ..session import scratch_path
from ..sources import files
from ..sources.models import load_model, save_model
from ..sources.tables import AS_OF, TXN_SQL
from .q_prepare import prepared_txn
from .registry import query

CATEGORICAL = ["merchant", "category", "gender", "job"]
NUMERIC = ["amt", "city_pop", "age", "trans_month", "trans_hour", "trans_day_of_week", "trans_day_of_month",
           "trans_day_of_year"]
BOXCOX_ALPHA = 0.5

M = f"""WITH txn AS ({TXN_SQL}),
m AS (SELECT txn_id, portion, is_fraud, merchant, category, gender, job, amt, city_pop,
             CAST(trunc(datediff('day', dob, DATE '{AS_OF}') / 365) AS INTEGER) AS age,
             CAST(month(trans_ts) AS INTEGER) AS trans_month, CAST(hour(trans_ts) AS INTEGER) AS trans_hour,
             CAST(dayofweek(trans_ts) + 1 AS INTEGER) AS trans_day_of_week,
             CAST(day(trans_ts) AS INTEGER) AS trans_day_of_month,
             CAST(dayofyear(trans_ts) AS INTEGER) AS trans_day_of_year FROM txn)"""


def model_frame(spark, sf_dir):
    """Model input: 4 categorical + 8 numeric columns, label, and txn_id / portion kept
    for joining and splitting (not used as features)."""
    p = prepared_txn(spark, sf_dir)
    return p.select("txn_id", "portion", "is_fraud", *CATEGORICAL, *NUMERIC)


def _pairs_sql():
    cols = []
    names = features.pairwise_names(NUMERIC)
    pairs = list(itertools.combinations(NUMERIC, 2))
    exprs = ([f"CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE)" for a, b in pairs]
             + [f"CAST({a} AS DOUBLE) + CAST({b} AS DOUBLE)" for a, b in pairs]
             + [f"CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)" for a, b in pairs])
    for e, n in zip(exprs, names):
        cols.append(f'{e} AS "{n}"')
    return ", ".join(cols)


@query("pairwise", f"{M} SELECT txn_id, {_pairs_sql()} FROM m")
def q_pairwise(spark, sf_dir):
    pw = features.PairwiseTransformer(inputCols=NUMERIC)
    out = pw.transform(model_frame(spark, sf_dir))
    return out.select("txn_id", *[F.col(f"`{c}`") for c in pw.getOutputCols()])


@query("log_features", f"""{M} SELECT txn_id, {', '.join(
    f'round(CASE WHEN {c} > 0 THEN ln({c}) END, 6) AS ln_{c}' for c in NUMERIC)} FROM m""")
def q_log_features(spark, sf_dir):
    lt = features.LogTransformer(inputCols=NUMERIC)
    out = lt.transform(model_frame(spark, sf_dir))
    return out.select("txn_id", *[F.round(c, 6).alias(c) for c in lt.getOutputCols()])


@query("boxcox", f"""{M} SELECT txn_id,
  round(CASE WHEN amt > 0 THEN (pow(amt, {BOXCOX_ALPHA}) - 1) / {BOXCOX_ALPHA} END, 6) AS amt_boxcox,
  round(CASE WHEN amt > 0 THEN ln(amt) END, 6) AS amt_boxcox0,
  round(CASE WHEN trans_hour > 0 THEN (pow(trans_hour, -1.0) - 1) / -1.0 END, 6) AS hour_boxcox_neg
FROM m""")
def q_boxcox(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    stages = [features.BoxCoxTransformer(inputCol="amt", outputCol="amt_boxcox", alpha=BOXCOX_ALPHA),
              features.BoxCoxTransformer(inputCol="amt", outputCol="amt_boxcox0", alpha=0.0),
              features.BoxCoxTransformer(inputCol="trans_hour", outputCol="hour_boxcox_neg", alpha=-1.0)]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.select("txn_id", *[F.round(c, 6).alias(c) for c in ("amt_boxcox", "amt_boxcox0", "hour_boxcox_neg")])


def _with_logs(spark, sf_dir):
    lt = features.LogTransformer(inputCols=NUMERIC)
    return lt.transform(model_frame(spark, sf_dir)), NUMERIC + lt.getOutputCols()


@query("invalid_rows", f"""{M}, flags AS (SELECT {', '.join(
    [f'({c} IS NULL) AS f_{c}' for c in NUMERIC] + [f'({c} IS NULL OR {c} <= 0) AS f_ln_{c}' for c in NUMERIC])} FROM m)
SELECT "column", CAST(n AS BIGINT) AS n_invalid FROM (
  {' UNION ALL '.join([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE f_{c}) AS n FROM flags" for c in NUMERIC]
                      + [f"SELECT 'ln_{c}', count(*) FILTER (WHERE f_ln_{c}) FROM flags" for c in NUMERIC])}
  UNION ALL SELECT '__any__', count(*) FILTER (WHERE {' OR '.join([f'f_{c}' for c in NUMERIC] + [f'f_ln_{c}' for c in NUMERIC])}) FROM flags
  UNION ALL SELECT '__rows__', count(*) FROM flags)""")
def q_invalid_rows(spark, sf_dir):
    df, cols = _with_logs(spark, sf_dir)
    return features.invalid_rows(df, cols)


_RANK_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", value, CAST(row_number() OVER (ORDER BY cnt DESC, value) - 1 AS INTEGER) AS idx FROM
        (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM m WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in CATEGORICAL)


def _indexed(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    stages = features.feature_stages(CATEGORICAL, NUMERIC)[:2]   # indexer + one-hot
    return Pipeline(stages=stages).fit(df).transform(df)


@query("string_index", f"{M}, ranks AS ({_RANK_SQL}) SELECT \"column\", value, idx AS \"index\" FROM ranks")
def q_string_index(spark, sf_dir):
    out = _indexed(spark, sf_dir)
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                                         F.col(f"{c}_index").cast("int").alias("index")) for c in CATEGORICAL]))
    return out.select(items.alias("s")).select("s.*").distinct()


# Rows of one merchant are kept from the fit, another merchant is NULL: both get the number after the last label.
_KEPT = "CASE WHEN merchant = 'm2' THEN NULL ELSE merchant END"


@query("string_index_table", f"""{M.replace('is_fraud, merchant,', f'is_fraud, {_KEPT} AS merchant,')},
seen AS (SELECT * FROM m WHERE merchant IS DISTINCT FROM 'm1'), ranks AS ({_RANK_SQL.replace('FROM m WHERE', 'FROM seen WHERE')}),
long AS ({' UNION '.join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM m" for c in CATEGORICAL)}),
n AS (SELECT "column", count(*) AS labels FROM ranks GROUP BY ALL)
SELECT l."column", l.value, CAST(coalesce(r.idx, n.labels) AS INTEGER) AS "index" FROM long l JOIN n ON l."column" = n."column"
LEFT JOIN ranks r ON l."column" = r."column" AND l.value = r.value""")
def q_string_index_table(spark, sf_dir):
    """The index as a table, in a pipeline that was saved and loaded, on values the fit did not see and NULLs."""
    df = model_frame(spark, sf_dir).withColumn("merchant", F.when(F.col("merchant") != "m2", F.col("merchant")))
    indexer = features.feature_stages(CATEGORICAL, NUMERIC, indexer="table")[0]
    fitted = Pipeline(stages=[indexer]).fit(df.where(~F.col("merchant").eqNullSafe("m1")))
    model = load_model(save_model(fitted, scratch_path(spark, "indexer")))
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                                         F.col(f"{c}_index").cast("int").alias("index")) for c in CATEGORICAL]))
    return model.transform(df).select(items.alias("s")).select("s.*").distinct()


@query("one_hot", f"""{M}, ranks AS ({_RANK_SQL}),
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM m" for c in CATEGORICAL)})
SELECT r."column", r.idx AS slot, (SELECT count(*) FROM m) AS rows, count(*) AS nonzeros
FROM long l JOIN ranks r ON l."column" = r."column" AND l.value = r.value GROUP BY r."column", r.idx""")
def q_one_hot(spark, sf_dir):
    """Rows of each slot, counted from the encoded vectors, all columns in one pass."""
    out = features.vector_slots_of(_indexed(spark, sf_dir), [f"{c}_ohe" for c in CATEGORICAL])
    return out.select(F.regexp_replace("column", "_ohe$", "").alias("column"), "slot", "rows", "nonzeros")


def _slot_sql():
    pairs = list(itertools.combinations(NUMERIC, 2))
    exprs = [(c, c) for c in NUMERIC] + [(f"ln_{c}", f"ln({c})") for c in NUMERIC]
    for op in "*+-":
        exprs += [(f"{a}{op}{b}", f"CAST({a} AS DOUBLE) {op} CAST({b} AS DOUBLE)") for a, b in pairs]
    numbers = " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS rows, count(*) FILTER (WHERE ({e}) <> 0) AS nonzeros, "
        f"round(avg({e}), 4) AS mean FROM f" for n, e in exprs)
    codes = " UNION ALL ".join(
        f"""SELECT '{c}_ohe_' || v.value, (SELECT count(*) FROM f), count(f.{c}),
            round(count(f.{c}) / (SELECT count(*) FROM f), 4)
            FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM m) v LEFT JOIN f ON CAST(f.{c} AS VARCHAR) = v.value
            GROUP BY v.value""" for c in CATEGORICAL)
    return f"{M}, f AS (SELECT * FROM m WHERE {' AND '.join(f'{c} > 0' for c in NUMERIC)}) {numbers} UNION ALL {codes}"


@query("assembled", _slot_sql())
def q_assembled(spark, sf_dir):
    """Rows, non-zeros and mean of every slot, from the assembled vectors."""
    df = model_frame(spark, sf_dir)
    model = Pipeline(stages=features.feature_stages(CATEGORICAL, NUMERIC)).fit(df)
    return features.named_slots(model.transform(df)).select("name", "rows", "nonzeros", F.round("mean", 4).alias("mean"))


@query("feature_roles", "SELECT * FROM (VALUES " + ", ".join(
    [f"('{c}', 'categorical')" for c in CATEGORICAL] + [f"('{c}', 'numeric')" for c in NUMERIC]) + ") AS t(name, role)")
def q_feature_roles(spark, sf_dir):
    """Roles of the model input's columns by type, checked against the columns' values."""
    df = model_frame(spark, sf_dir)
    cat, num = files.feature_roles(df, exclude=["txn_id", "portion"])
    counts = df.agg(*[F.count(c).alias(c) for c in cat + num])
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(r).alias("role"), F.col(c).alias("n"))
                      for r, cs in (("categorical", cat), ("numeric", num)) for c in cs])
    return counts.select(F.inline(cells)).where("n > 0").select("name", "role")


def split_model_frame(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    return prepare.split_portions(df)
