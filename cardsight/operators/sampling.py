"""Sampling and fold assignment (D1, D2, K4 folds).

``stratified_sample`` (D2) and ``assign_folds`` decide per row from a hash of
(seed, key): the result does not depend on partitioning, file layout or retries, which
matters when an executor is lost and a task is recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hash01
from .ordered import running_totals


def sample_by_native(df: DataFrame, column: str, fractions: dict, seed: int) -> DataFrame:
    """Spark's stratified Bernoulli sample (D1). Strata missing from ``fractions`` are
    dropped; which rows survive depends on the partition layout even with a seed."""
    return df.sampleBy(column, fractions=fractions, seed=seed)


def _fraction_expr(column: str, fractions: dict, default: float | None):
    expr = None
    for value, frac in fractions.items():
        cond = F.col(column) == F.lit(value)
        expr = F.when(cond, F.lit(float(frac))) if expr is None else expr.when(cond, F.lit(float(frac)))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def stratified_sample(df: DataFrame, column: str, fractions: dict, seed: int, key: str,
                      default: float | None = None) -> DataFrame:
    """Keep a row iff ``hash01(seed, key) < fraction(class)``.

    Same strata semantics as D1 (absent strata dropped unless ``default`` is given), but
    reproducible on any layout; a pure filter, so it fuses with the scan and never shuffles.
    Rows with a NULL key are kept or left out together.
    """
    return df.where(hash01(key, seed) < _fraction_expr(column, fractions, default))


def assign_folds(df: DataFrame, k: int, seed: int, key: str, column: str = "fold") -> DataFrame:
    """Fold number 0..k-1 per row from a hash of (seed, key) (K4); NULL keys share a fold."""
    return df.withColumn(column, F.floor(hash01(key, seed) * F.lit(k)).cast("int"))


def balanced_folds(df: DataFrame, k: int, seed: int, key: str, label: str, column: str = "fold") -> DataFrame:
    """Fold number 0..k-1 per row, dealt round robin in the order of the key's hash within each class (K4).

    Every fold has each class's rows to within one, so a class of ``k`` rows or more is in every fold, which
    hashed folds (:func:`assign_folds`) cannot promise. The same on any layout for distinct keys; rows that
    share a key are neighbours in the order. The ranks come from one range exchange (see ``ordered``)."""
    order = F.struct(hash01(key, seed).alias("h"), F.col(f"`{key}`").alias("k"))
    ranked = running_totals(df.withColumns({"_order": order, "_one": F.lit(1).cast("long")}), "_order", ["_one"], by=[label])
    fold = F.pmod(F.col("_one_cum") - 1, F.lit(k)).cast("int")
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns if c != column], fold.alias(column))
