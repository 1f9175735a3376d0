"""Named queries over the driver tables, each with its DuckDB oracle when one exists.

Every query reads whole tables (``events`` through the transaction view, ``lineitem``,
``part``, ``orders``) and returns a DataFrame without collecting it. Floats are rounded
in both the Spark query and its oracle (6 places for measurements, 9 for ratios).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with optional oracle SQL."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_prepare, q_evaluate, q_explore, q_features, q_models, q_tables  # noqa: F401
