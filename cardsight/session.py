"""Session set-up (A7), scoped caching (A6) and the shared scratch folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale. AQE re-plans joins from runtime sizes (a sort-merge join
# turns into a broadcast only when the materialised side is measured small), coalesces
# tiny shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.debug.maxToStringFields": "100",
    "spark.ui.enabled": "false",
}


def get_session(app_name: str = "cardsight", master: str | None = None,
                conf: dict[str, str] | None = None, log_level: str = "ERROR") -> SparkSession:
    """Return the active session, or build one with :data:`DEFAULT_CONF` plus ``conf``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read and write.

    Uses the cluster's ``spark.checkpoint.dir`` (or a checkpoint dir already set on the
    context). Only when neither is set on a ``local`` master - tests - a private folder
    is created and registered as the checkpoint dir; on a cluster that would be a
    machine-local folder the other executors cannot read, so it is an error instead.
    """
    conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach "
                           "(HDFS, S3, ...): exact ranks and quantiles checkpoint there")
    local = tempfile.mkdtemp(prefix="cardsight-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below :func:`shared_dir`."""
    return os.path.join(shared_dir(spark), "cardsight", f"{name}-{uuid.uuid4().hex[:12]}")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below :func:`shared_dir` and read again: later uses see the same rows even if ``df`` is not
    deterministic, joins see its size, and lost executors cost a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Persist ``df`` for the block and always release it afterwards."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
