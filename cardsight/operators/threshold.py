"""Threshold tuning.

A sweep over m cut-offs t_i = start + step * i is one job: each row is mapped to the
number of cut-offs strictly below its score, counts per (bucket, class) are aggregated
map-side (at most (m + 1) * 2 rows per group leave each task), and the counts predicted
positive at t_i are suffix sums over that tiny table. The evaluator-per-threshold style
scans the scored data 2 * m times instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import above
from .evaluate import RATIO_DIGITS, classification_report
from .joins import join_null_safe

# The reference sweep, 36 cut-offs 0.1, 0.125, ..., 0.975.
SWEEP_START = 0.1
SWEEP_STEP = 0.025
SWEEP_COUNT = 36


def threshold_value(i: Column, start: float = SWEEP_START, step: float = SWEEP_STEP) -> Column:
    """t_i as the same double expression everywhere (start + step * i)."""
    return F.lit(float(start)) + F.lit(float(step)) * i.cast("double")


def cutoffs_below(score: Column, start: float, step: float, count: int) -> Column:
    """Number of cut-offs t_0..t_{count-1} strictly below ``score`` (so prediction at t_i
    is positive iff the result > i). Arithmetic guess, then one exact correction each
    way against the same double thresholds; codegen-friendly (no lambdas)."""
    guess = F.least(F.greatest(F.ceil((score - F.lit(start)) / F.lit(step)), F.lit(0)), F.lit(count)).cast("int")
    too_high = (guess > 0) & ~(score > threshold_value(guess - 1, start, step))
    too_low = (guess < count) & (score > threshold_value(guess, start, step))
    # NaN compares greater than every number in Spark, so it is above every cut-off
    # (ceil(NaN) as a long would otherwise put it in bucket 0 or 1).
    return (F.when(F.isnan(score), F.lit(count)).when(too_high, guess - 1).when(too_low, guess + 1)
            .otherwise(guess)).cast("int")


def threshold_sweep(df: DataFrame, label: str, score: str, by: list[str] | None = None,
                    start: float = SWEEP_START, step: float = SWEEP_STEP, count: int = SWEEP_COUNT,
                    positive: float = 1.0, digits: int = RATIO_DIGITS) -> DataFrame:
    """Confusion counts and weighted precision / recall / F1 at each cut-off (K1).

    Prediction is ``score > t`` (strict). Weighted metrics follow Spark's multiclass
    evaluator: classes are the labels present, a zero denominator gives 0, weights are
    class supports; weighted recall equals accuracy. Rows with a NULL score are
    ignored.
    """
    by = list(by or [])
    y = F.col(label).cast("double") == F.lit(positive)
    bucketed = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
                .select(*by, cutoffs_below(F.col(score).cast("double"), start, step, count).alias("k"),
                        y.alias("y")))
    counts = bucketed.groupBy(*by, "k").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))

    # Dense grid of cut-offs per group: i = 0..count-1, as an array exploded per group.
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(count))).alias("k"))
    dense = join_null_safe(grid, counts, [*by, "k"], "left").fillna(0, ["pos", "neg"])
    # Predicted positive at t_i: rows with k > i, i.e. suffix sums from k = i + 1.
    suffix = Window.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    cum = dense.select(*by, "k", F.sum("pos").over(suffix).alias("tp"), F.sum("neg").over(suffix).alias("fp"),
                       F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"))
    sweep = cum.where(F.col("k") >= 1).withColumn("i", F.col("k") - 1)

    tp, fp, P, N = (F.col(c) for c in ("tp", "fp", "P", "N"))
    fn, tn = P - tp, N - fp
    n = P + N

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)

    prec1, prec0 = ratio(tp, tp + fp), ratio(tn, tn + fn)
    rec1, rec0 = ratio(tp, P), ratio(tn, N)
    f1_1 = ratio(2 * tp, P + tp + fp)
    f1_0 = ratio(2 * tn, N + tn + fn)
    w_prec = ratio(P * prec1 + N * prec0, n)
    w_rec = ratio(tp + tn, n)
    w_f1 = ratio(P * f1_1 + N * f1_0, n)
    return sweep.select(
        *by, F.col("i").cast("int").alias("threshold_index"),
        F.round(threshold_value(F.col("i"), start, step), 6).alias("threshold"),
        tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
        tn.cast("bigint").alias("tn"), fn.cast("bigint").alias("fn"),
        F.round(w_prec, digits).alias("weighted_precision"),
        F.round(w_rec, digits).alias("weighted_recall"),
        F.round(w_f1, digits).alias("weighted_f1"))


OBJECTIVES = {"precision": "weighted_precision", "recall": "weighted_recall", "f1": "weighted_f1"}


def best_threshold(sweep: DataFrame, objective: str = "precision", by: list[str] | None = None) -> DataFrame:
    """Cut-off with the highest objective; the lowest cut-off wins ties.

    Works on the sweep table (``count`` rows per group), so the window is tiny.
    """
    by = list(by or [])
    metric = OBJECTIVES.get(objective, objective)
    w = Window.partitionBy(*by).orderBy(F.desc(metric), F.asc("threshold_index"))
    return sweep.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def score_at_threshold(df: DataFrame, label: str, score: str, threshold: float, by: list[str] | None = None,
                       zero_division: float = 0.0) -> DataFrame:
    """Hard predictions ``score > threshold`` and their classification report (K3)."""
    hard = df.withColumn("_pred", above(score, threshold))
    return classification_report(hard, label, "_pred", by=by, zero_division=zero_division)
