"""File sources and sinks (A1, A2) and schema inspection (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

# For files of our own writer: full microsecond precision survives a CSV round trip.
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             infer: bool = False, header: bool = True, timestamp_format: str | None = None) -> DataFrame:
    """CSV file or directory with a header (A1).

    An explicit ``schema`` is the default path; ``infer=True`` reproduces type inference,
    which reads the input one extra time. Timestamps are read as Spark reads them
    (``yyyy-MM-dd HH:mm:ss`` and ISO forms) unless ``timestamp_format`` names a pattern,
    such as :data:`CSV_TIMESTAMP_FORMAT`; :func:`unparsed` counts values that a typed
    read turned into NULL.
    """
    reader = spark.read.option("header", header)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def unparsed(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
             timestamp_format: str | None = None) -> DataFrame:
    """(column, count) of values that are present in the text but NULL once typed.

    One scan: the file is read as strings and every column is parsed beside its text."""
    text = read_csv(spark, path, T.StructType([T.StructField(f.name, T.StringType()) for f in schema]), header=header)

    def parsed(f: T.StructField):
        if timestamp_format and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.try_to_timestamp(F.col(f"`{f.name}`"), F.lit(timestamp_format))
        return F.col(f"`{f.name}`").try_cast(f.dataType)

    lost = [F.count_if(F.col(f"`{f.name}`").isNotNull() & parsed(f).isNull()).alias(f"c{i}") for i, f in enumerate(schema)]
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"c{i}").alias("count")) for i, f in enumerate(schema)])
    return text.agg(*lost).select(F.inline(cells))


REJECTED = "_rejected"
REASON = "_reason"


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                     timestamp_format: str | None = None) -> DataFrame:
    """Typed rows of a CSV file or directory, each with what is wrong with its line (A1).

    Adds ``_rejected`` - the line as it stands in the file, or NULL for a line that was read in full - and
    ``_reason``: ``fields`` for a line with fewer or more fields than ``schema``, else the names of the columns whose
    text does not parse, comma-joined. A rejected row keeps the values that did parse. One scan without column
    pruning, since a pruned read does not notice what is wrong in the columns it skips.
    """
    own = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())])
    options = {"header": header, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED, "columnPruning": False}
    if timestamp_format:
        options |= {"timestampFormat": timestamp_format, "timestampNTZFormat": timestamp_format}
    rows = spark.read.schema(own).options(**options).csv(path)
    # the rejected line again, as text: its own corrupt column is set if the number of fields is wrong
    strings = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema], T.StructField(REJECTED, T.StringType())])
    text = F.from_csv(REJECTED, F.lit(strings.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")),
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED})
    lost = F.concat_ws(",", *[F.when(F.col("_t")[f.name].isNotNull() & F.col(f"`{f.name}`").isNull(), F.lit(f.name)) for f in schema])
    reason = F.when(F.col("_t")[REJECTED].isNotNull(), F.lit("fields")).otherwise(lost)
    return rows.withColumn("_t", F.when(F.col(REJECTED).isNotNull(), text)) \
        .withColumn(REASON, F.when(F.col(REJECTED).isNotNull(), reason)).drop("_t")


def ingest_csv(spark: SparkSession, path: str, out: str, schema: T.StructType, header: bool = True,
               timestamp_format: str | None = None, mode: str = "errorifexists") -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected lines) of a CSV file or directory, every line in exactly one of them.

    One scan writes both, as two partitions of the Parquet folder ``out``; the rejected ones come as
    (line, reason)."""
    checked = read_csv_checked(spark, path, schema, header, timestamp_format)
    checked.withColumn("accepted", F.col(REJECTED).isNull()).write.mode(mode).partitionBy("accepted").parquet(out)
    stored = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType()), T.StructField(REASON, T.StringType()),
                           T.StructField("accepted", T.BooleanType())])
    rows = spark.read.schema(stored).parquet(out)
    return (rows.where("accepted").select(*[F.col(f"`{f.name}`") for f in schema]),
            rows.where("not accepted").select(F.col(REJECTED).alias("line"), F.col(REASON).alias("reason")))


def read_raw_transactions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema=schemas.RAW_TRANSACTIONS)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True,
              partition_by: list[str] | None = None) -> None:
    """CSV with header (A2). Default mode fails if ``path`` exists, as the plain writer does."""
    w = (df.write.mode(mode).option("header", header)
         .option("timestampFormat", CSV_TIMESTAMP_FORMAT)
         .option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: list[str] | None = None) -> None:
    """Typed twin of :func:`write_csv`; ``partition_by=['portion']`` lets a later
    ``where(portion = ...)`` prune whole directories."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def feature_role(name: str, dtype: T.DataType, label: str | None) -> str:
    if label is not None and name == label:
        return "label"
    if isinstance(dtype, T.StringType):
        return "categorical"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "other"


def profile_schema(df: DataFrame, label: str | None = schemas.LABEL) -> DataFrame:
    """One row per column: position, name, dtype, nullable, role, non_null.

    ``non_null`` counts the column's values, all columns in one aggregate over the data."""
    fields = df.schema.fields
    cells = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"),
        F.lit(f.nullable).alias("nullable"), F.lit(feature_role(f.name, f.dataType, label)).alias("role"),
        F.col(f"c{i}").alias("non_null")) for i, f in enumerate(fields)])
    return df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)]).select(F.inline(cells))


def preview(df: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows in order of ``keys`` (A5): the same rows on any layout if the keys tell rows apart.
    Every task keeps its own first ``n``."""
    return df.orderBy(*[F.col(f"`{k}`").asc() for k in keys]).limit(n)


HLL_BITS = 12


def distinct_error(bits: int = HLL_BITS) -> float:
    """Relative standard error of the distinct counts of :func:`profile_columns`."""
    return 0.8326 / 2 ** (bits / 2)


def profile_columns(df: DataFrame, bits: int = HLL_BITS, k: int = 4096) -> DataFrame:
    """One row per column: position, name, dtype, rows, nulls, nan, n_distinct, min, max, mean, q1, median, q3 (A5).

    All columns in one aggregate whose buffers have a fixed size: a HyperLogLog sketch for the distinct values
    (NULL not counted; relative standard error :func:`distinct_error`), and for numbers a KLL sketch for the
    quartiles (values of the column; rank error 0.07 % at ``k`` = 4096). NaN is left out of the statistics of
    numbers; ``min`` and ``max`` are text."""
    aggs, cells = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        plain = isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))
        x = c.cast("double")
        known = F.when(~F.isnan(x), c) if number else c
        sketched = known if isinstance(f.dataType, (T.StringType, T.IntegerType, T.LongType)) else known.cast("string")
        value = F.when(~F.isnan(x), x) if number else F.lit(None).cast("double")
        aggs += [F.count(c).alias(f"n{i}"), (F.count_if(F.isnan(x)) if number else F.lit(0).cast("long")).alias(f"nan{i}"),
                 (F.min(known).cast("string") if plain else F.lit(None).cast("string")).alias(f"lo{i}"),
                 (F.max(known).cast("string") if plain else F.lit(None).cast("string")).alias(f"hi{i}"),
                 (F.avg(value) if number else F.lit(None).cast("double")).alias(f"mean{i}"),
                 (F.hll_sketch_estimate(F.hll_sketch_agg(sketched, F.lit(bits))) if plain else F.lit(None).cast("long")).alias(f"d{i}")]
        if number:
            aggs.append(F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(
                F.kll_sketch_agg_double(value, F.lit(k)), F.array(F.lit(.25), F.lit(.5), F.lit(.75)))).alias(f"q{i}"))
        q = [F.col(f"q{i}")[j] if number else F.lit(None).cast("double") for j in range(3)]
        cells.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("rows"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"nan{i}").alias("nan"),
            F.col(f"d{i}").alias("n_distinct"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            F.col(f"mean{i}").alias("mean"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def feature_roles(df: DataFrame, label: str = schemas.LABEL,
                  exclude: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Split columns into (categorical, numeric) by type, the label and ``exclude`` left out."""
    skip = set(exclude or []) | {label}
    cat = [f.name for f in df.schema.fields
           if f.name not in skip and isinstance(f.dataType, T.StringType)]
    num = [f.name for f in df.schema.fields
           if f.name not in skip and isinstance(f.dataType, T.NumericType)]
    return cat, num
