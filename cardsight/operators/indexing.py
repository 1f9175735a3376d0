"""String indexing by a table (F9): labels and their numbers stay in storage.

``StringIndexer`` brings every label of a column to the driver and sends the array to every task. Here the fitted
index is a Parquet table (column, value, index) that is joined: Spark broadcasts it if its files are small and
shuffles otherwise. Numbers follow falling frequency, ties in alphabetical order, and come from one range exchange
over the distinct values (see ``ordered``). The model holds only the table's path and the number of labels a column.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasHandleInvalid, HasInputCols, HasOutputCols, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .distribution import group_count, long_form
from .ordered import running_totals

SCHEMA = "column string, value string, index double"


def index_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, index) of every non-NULL value: 0 for the most frequent one of its column."""
    counts = group_count(long_form(df.select(*[f"`{c}`" for c in columns]), columns).where(F.col("value").isNotNull()), "column", "value")
    order = F.struct((-F.col("count")).alias("c"), F.col("value").alias("v"))
    ranked = running_totals(counts.select("column", "value", order.alias("_order"), F.lit(1).cast("long").alias("_one")),
                            "_order", ["_one"], by=["column"])
    return ranked.select("column", "value", (F.col("_one_cum") - 1).cast("double").alias("index"))


class _IndexParams(HasInputCols, HasOutputCols, HasHandleInvalid):
    """``handleInvalid``: what becomes of NULL and of values unknown to the fit - ``keep`` (number after the
    last label), ``skip`` (the row goes) or ``error``."""

    path = Param(Params._dummy(), "path", "folder of the index table", typeConverter=TypeConverters.toString)
    sizes = Param(Params._dummy(), "sizes", "labels of each input column", typeConverter=TypeConverters.toListInt)


class TableIndexer(Estimator, _IndexParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits :class:`TableIndexerModel`. ``path``: where to keep the table (default: the shared scratch folder)."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, handleInvalid="keep", path=None):
        super().__init__()
        self._setDefault(handleInvalid="keep")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @keyword_only
    def setParams(self, inputCols=None, outputCols=None, handleInvalid="keep", path=None):
        return self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> TableIndexerModel:
        spark, columns = df.sparkSession, self.getInputCols()
        path = self.getOrDefault(self.path) if self.isDefined(self.path) else scratch_path(spark, "index")
        index_table(df, columns).write.mode("overwrite").partitionBy("column").parquet(path)
        table = spark.read.schema(SCHEMA).parquet(path)
        sizes = {r.column: r["count"] for r in group_count(table, "column").collect()}     # one row a column
        model = TableIndexerModel()
        model._set(inputCols=columns, outputCols=self.getOutputCols(), handleInvalid=self.getHandleInvalid(), path=path,
                   sizes=[int(sizes.get(c, 0)) for c in columns])
        return model


class TableIndexerModel(Model, _IndexParams, MLReadable, MLWritable):
    """Adds each output column: the number of the input's value, with the number of labels in its metadata."""

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.getOrDefault(self.path))

    def _transform(self, df: DataFrame) -> DataFrame:
        table, invalid = self.table(df.sparkSession), self.getHandleInvalid()
        names = df.columns
        for c, out, n in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.sizes)):
            mine = table.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("index").alias("_index"))
            df = df.join(mine, F.col(f"`{c}`").cast("string") == F.col("_value"), "inner" if invalid == "skip" else "left")
            last = F.lit(float(n)) if invalid == "keep" else F.raise_error(
                F.concat(F.lit(f"{c}: unknown value "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")))).cast("double")
            attr = {"ml_attr": {"type": "nominal", "name": out, "num_vals": n + (invalid == "keep")}}
            names = [*names, out]
            df = df.withColumn(out, F.coalesce("_index", last)).select(*[f"`{x}`" for x in names[:-1]], F.col(f"`{out}`").alias(out, metadata=attr))
        return df

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """Parameters and the table itself, so that a saved pipeline does not depend on the scratch folder."""

    def __init__(self, model: TableIndexerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table(self.sparkSession).write.partitionBy("column").parquet(f"{path.rstrip('/')}/table")


class _Reader(MLReader):
    def load(self, path: str) -> TableIndexerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TableIndexerModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._set(path=f"{path.rstrip('/')}/table")
