"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_scopes: list[list[str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    path = f"{shared_dir(spark)}/cardsight-llm/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def collected(paths: list[str]) -> Iterator[None]:
    """Every path that :func:`folder` makes inside is added to ``paths``."""
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that no plan reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The stored result of ``make``, without the tables it needed on the way."""
    used: list[str] = []
    with collected(used):
        out = make()
    out = stored(out, name)
    delete(spark, used)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives
    lost executors. Shuffle files of the finished jobs are released afterwards."""
    spark = df.sparkSession
    path = folder(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more. A hint: what
    is still referred to goes at a later one, and nothing waits for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Tasks for ``n_bytes`` at ``each`` bytes a task, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-int(n_bytes) // each), 1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with DuckDB SQL where there is one."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
