"""Scoring a stream of transactions with a fitted pipeline (H4 + B7 on a stream).

The reference scores in batch only; this applies the same fitted ``PipelineModel`` and
strict cut-off to a Structured Streaming source, so new transactions are scored as they
arrive. Every stage in the pipeline is row-wise (indexing, one-hot, logs, pairwise,
assembler, tree ensemble), so the model runs unchanged on a streaming DataFrame.
No state is kept: nothing grows with the stream.
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import above
from ..operators.models import positive_probability
from ..session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """File source with an explicit schema (no inference on a stream)."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score_stream(model: PipelineModel, stream: DataFrame, threshold: float = 0.5,
                 keep: list[str] | None = None) -> DataFrame:
    """(keep..., p1, flagged): class-1 probability and ``p1 > threshold`` as 0/1."""
    out = model.transform(stream)
    p1 = positive_probability()
    return out.select(*[F.col(c) for c in (keep or [])], p1.alias("p1"), above(p1, threshold).alias("flagged"))


def write_stream(scored: DataFrame, path: str, checkpoint: str | None = None, fmt: str = "parquet",
                 available_now: bool = False, processing_time: str | None = None) -> StreamingQuery:
    """Append scored rows to files; the checkpoint lives in the shared folder so a
    restarted query resumes exactly where it stopped."""
    spark = scored.sparkSession
    ckpt = checkpoint or scratch_path(spark, "stream-ckpt")
    w = scored.writeStream.format(fmt).outputMode("append").option("checkpointLocation", ckpt)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start(os.fspath(path))


def run_to_completion(query: StreamingQuery, timeout_sec: float | None = None) -> None:
    """Wait for an available-now query and raise if it failed. With ``timeout_sec`` a query that
    is not done in time is stopped; there is no limit by default."""
    if timeout_sec is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_sec):
        query.stop()
        raise TimeoutError(f"streaming query {query.name or query.id} did not finish in {timeout_sec}s")
    err = query.exception()
    if err is not None:
        raise RuntimeError(f"streaming query failed: {err}")
