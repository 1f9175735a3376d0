"""Evaluation as distributed aggregations.

Every metric starts from one partial-aggregated count per (group, actual, predicted) or
per (group, distinct score); only those counts cross a shuffle. Nothing is collected.
``by`` adds grouping columns (``model``, ``portion``, fold ...): many models or portions
are evaluated in the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from .joins import join_null_safe
from .ordered import running_totals

RATIO_DIGITS = 9


def _zero(zero_value) -> Column:
    return zero_value.cast("double") if isinstance(zero_value, Column) else F.lit(float(zero_value))


def _safe_div(num: Column, den: Column, zero_value) -> Column:
    """``num / den``, or ``zero_value`` (a number, or a Column of the group) when den = 0."""
    return F.when(den == 0, _zero(zero_value)).otherwise(num.cast("double") / den)


def zero_division_by_model(names_one: tuple = ("RandomForest",), column: str = "model") -> Column:
    """Per-model zero-division value for grouped reports: 1 for the listed model names,
    0 otherwise (the reference's rule for its random-forest report)."""
    return F.when(F.col(column).isin(*names_one), F.lit(1.0)).otherwise(F.lit(0.0))


def confusion(df: DataFrame, label: str, prediction: str, by: list[str] | None = None,
              classes: list | None = None) -> DataFrame:
    """Counts per (actual, predicted).

    With ``classes`` the table is dense: every (actual, predicted) pair of the list is
    present per group, absent cells as 0; observed cells outside the list are kept.
    """
    by = list(by or [])
    counts = (df.groupBy(*by, F.col(label).cast("double").alias("actual"),
                         F.col(prediction).cast("double").alias("predicted"))
              .agg(F.count(F.lit(1)).alias("count")))
    if classes is None:
        return counts
    lits = F.array(*[F.lit(float(c)) for c in classes])
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    grid = (groups.withColumn("actual", F.explode(lits))
            .withColumn("predicted", F.explode(lits)))
    return (join_null_safe(grid, counts, [*by, "actual", "predicted"], "full_outer")
            .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("bigint")))


def per_class(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """From confusion cells: per (group, class) tp, support (actual count), predicted count.

    Each cell contributes to its actual class and to its predicted class; one
    ``explode`` + one aggregation, no join.
    """
    by = list(by or [])
    zero = F.lit(0).cast("bigint")
    cnt = F.col("count").cast("bigint")
    as_actual = F.struct(F.col("actual").alias("class"), cnt.alias("support"),
                         F.when(F.col("actual") == F.col("predicted"), cnt).otherwise(zero).alias("tp"),
                         zero.alias("n_predicted"))
    as_predicted = F.struct(F.col("predicted").alias("class"), zero.alias("support"), zero.alias("tp"),
                            cnt.alias("n_predicted"))
    parts = cells.select(*by, F.explode(F.array(as_actual, as_predicted)).alias("c")).select(*by, "c.*")
    return parts.groupBy(*by, "class").agg(*[F.sum(c).cast("bigint").alias(c)
                                              for c in ("tp", "support", "n_predicted")])


def classification_report(df: DataFrame, label: str, prediction: str, by: list[str] | None = None,
                          zero_division=0.0, digits: int = RATIO_DIGITS) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted means.

    Classes are the union of actual and predicted values. A ratio with a zero denominator
    takes ``zero_division`` (a number, or a Column over the ``by`` columns such as
    :func:`zero_division_by_model`). F1 = 2 tp / (support + predicted).
    Output rows: ``row`` = class value as text, 'accuracy', 'macro avg', 'weighted avg'.
    One scan: confusion cells -> per-class sums -> group totals by a window over the
    per-class rows (a handful per group) -> all report rows from one ``explode``.
    """
    by = list(by or [])
    pc = per_class(confusion(df, label, prediction, by), by)
    m = pc.select(
        *by, "class", "support", "tp",
        _safe_div(F.col("tp"), F.col("n_predicted"), zero_division).alias("precision"),
        _safe_div(F.col("tp"), F.col("support"), zero_division).alias("recall"),
        _safe_div(2 * F.col("tp"), F.col("support") + F.col("n_predicted"), zero_division).alias("f1_score"))
    g = Window.partitionBy(*by)
    m = m.withColumns({
        "n": F.sum("support").over(g), "tp_all": F.sum("tp").over(g), "k": F.count(F.lit(1)).over(g),
        "sp": F.sum("precision").over(g), "sr": F.sum("recall").over(g), "sf": F.sum("f1_score").over(g),
        "wp": F.sum(F.col("precision") * F.col("support")).over(g),
        "wr": F.sum(F.col("recall") * F.col("support")).over(g),
        "wf": F.sum(F.col("f1_score") * F.col("support")).over(g),
        "_first": F.row_number().over(g.orderBy(F.col("class").asc_nulls_first())) == 1})
    n = F.col("n")
    none = F.lit(None).cast("double")

    def row(name, p, r, f, support):
        return F.struct(name.alias("row"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f.cast("double").alias("f1_score"), support.cast("bigint").alias("support"))

    first = F.col("_first")
    rows = F.array(
        row(F.col("class").cast("string"), F.col("precision"), F.col("recall"), F.col("f1_score"), F.col("support")),
        F.when(first, row(F.lit("accuracy"), none, none, _safe_div(F.col("tp_all"), n, zero_division), n)),
        F.when(first, row(F.lit("macro avg"), F.col("sp") / F.col("k"), F.col("sr") / F.col("k"),
                          F.col("sf") / F.col("k"), n)),
        F.when(first, row(F.lit("weighted avg"), _safe_div(F.col("wp"), n, zero_division),
                          _safe_div(F.col("wr"), n, zero_division), _safe_div(F.col("wf"), n, zero_division), n)))
    out = m.select(*by, F.explode(rows).alias("r")).where(F.col("r").isNotNull()).select(*by, "r.*")
    return out.select(*by, "row", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                      "support")


def balanced_accuracy(df: DataFrame, label: str, prediction: str, by: list[str] | None = None,
                      positive: float = 1.0, digits: int = RATIO_DIGITS) -> DataFrame:
    """Area under ROC of a hard 0/1 prediction = (TPR + TNR) / 2.

    This is what ``BinaryClassificationEvaluator(rawPredictionCol=<0/1 prediction>)``
    returns. NULL when a class is absent.
    """
    by = list(by or [])
    y = F.col(label).cast("double") == F.lit(positive)
    p = F.col(prediction).cast("double") == F.lit(positive)
    agg = df.groupBy(*by).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"))
    tpr = F.col("tp") / F.col("pos")
    tnr = F.col("tn") / F.col("neg")
    value = F.when((F.col("pos") > 0) & (F.col("neg") > 0), (tpr + tnr) / 2)
    return agg.select(*by, F.round(value, digits).alias("balanced_accuracy"))


def score_counts(df: DataFrame, label: str, score: str, by: list[str] | None = None,
                 positive: float = 1.0, bins: int | None = None) -> DataFrame:
    """Positives and negatives per distinct score (map-side combined).

    ``bins`` (for scores in [0, 1]) first snaps each score down to a grid of ``bins``
    steps, so at most ``bins + 1`` rows per group are shuffled whatever the data size
    (an approximation like Spark's ``numBins``); ``None`` keeps every distinct score.
    """
    by = list(by or [])
    y = f"CAST({quoted(label)} AS double) = {float(positive)}D"
    s = f"CAST({quoted(score)} AS double)"
    if bins:
        # NaN and infinite scores keep a step of their own: floor() would move them to another side
        s = f"CASE WHEN isnan({s}) OR abs({s}) = double('inf') THEN {s} ELSE floor({s} * {int(bins)}) / {float(bins)}D END"
    return (df.where(f"{quoted(score)} IS NOT NULL")
            .groupBy(*by, F.expr(f"{s} AS score"))
            .agg(F.expr(f"count_if({y}) AS pos"), F.expr(f"count_if(NOT ({y})) AS neg")))


def roc_curve(df: DataFrame, label: str, score: str, by: list[str] | None = None,
              positive: float = 1.0, ranges: int | None = None, digits: int = RATIO_DIGITS,
              bins: int | None = None) -> DataFrame:
    """ROC points, one per distinct score, thresholds descending.

    tp / fp = positives / negatives with score >= threshold; tpr = tp / P, fpr = fp / N.
    Cumulative counts use :func:`running_totals`, so no task sees more than one range.
    """
    by = list(by or [])
    counts = score_counts(df, label, score, by, positive, bins)
    out = running_totals(counts, "score", ["pos", "neg"], by=by, descending=True, ranges=ranges)
    return out.selectExpr(
        *[quoted(c) for c in by], "score AS threshold", "pos_cum AS tp", "neg_cum AS fp",
        f"round(CASE WHEN pos_total > 0 THEN pos_cum / pos_total END, {digits}) AS tpr",
        f"round(CASE WHEN neg_total > 0 THEN neg_cum / neg_total END, {digits}) AS fpr")


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None,
            positive: float = 1.0, ranges: int | None = None, digits: int = RATIO_DIGITS,
            bins: int | None = None) -> DataFrame:
    """Area under the ROC curve of a score (I4), ties counted one half.

    AUC = sum over distinct scores s of neg(s) * (pos(score > s) + pos(s) / 2) / (P * N),
    the trapezoid area of the full ROC curve. The numerator is kept exact as an integer.
    """
    by = list(by or [])
    counts = score_counts(df, label, score, by, positive, bins)
    # both counts, so that the totals read the same exchange as the rows
    cum = running_totals(counts, "score", ["pos", "neg"], by=by, descending=True, ranges=ranges)
    # 2 * neg * (pos above s) + neg * pos(s) = neg * (2 * pos_cum - pos)
    dec = "decimal(38,0)"
    agg = cum.groupBy(*by).agg(
        F.expr(f"sum(CAST(neg AS {dec}) * (CAST(pos_cum AS {dec}) * 2 - CAST(pos AS {dec}))) AS num2"),
        F.expr("sum(pos) AS positives"), F.expr("sum(neg) AS negatives"))
    value = "CAST(num2 AS double) / (CAST(positives AS double) * CAST(negatives AS double) * 2)"
    return agg.selectExpr(*[quoted(c) for c in by], f"round(CASE WHEN positives > 0 AND negatives > 0 THEN {value} END, {digits}) AS auc",
                          "positives", "negatives")


MULTI_METRICS = ["f1", "weightedRecall", "weightedPrecision", "accuracy", "precisionByLabel",
                 "recallByLabel", "fMeasureByLabel"]


def multi_metrics(df: DataFrame, label: str, prediction: str, by: list[str] | None = None,
                  metric_label: float = 0.0, beta: float = 1.0, digits: int = RATIO_DIGITS) -> DataFrame:
    """The seven multiclass metrics from one confusion table.

    Spark semantics: classes are the values seen in ``label``; a ratio with a zero
    denominator is 0; the *ByLabel metrics describe ``metric_label`` (default 0.0).
    """
    by = list(by or [])
    pc = per_class(confusion(df, label, prediction, by), by).where(F.col("support") > 0)
    b2 = beta * beta
    prec = _safe_div(F.col("tp"), F.col("n_predicted"), 0.0)
    rec = _safe_div(F.col("tp"), F.col("support"), 0.0)
    pc = pc.withColumns({"precision": prec, "recall": rec})
    fden = F.lit(b2) * F.col("precision") + F.col("recall")
    pc = pc.withColumn("fmeasure", F.when(fden == 0, F.lit(0.0)).otherwise(
        F.lit(1 + b2) * F.col("precision") * F.col("recall") / fden))
    is_m = F.col("class") == F.lit(float(metric_label))
    agg = pc.groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.sum(F.col("support") * F.col("precision")).alias("wp"),
        F.sum(F.col("support") * F.col("recall")).alias("wr"),
        F.sum(F.col("support") * F.col("fmeasure")).alias("wf"),
        F.coalesce(F.max(F.when(is_m, F.col("precision"))), F.lit(0.0)).alias("pbl"),
        F.coalesce(F.max(F.when(is_m, F.col("recall"))), F.lit(0.0)).alias("rbl"),
        F.coalesce(F.max(F.when(is_m, F.col("fmeasure"))), F.lit(0.0)).alias("fbl"))
    n = F.col("n")
    values = {
        "f1": F.col("wf") / n, "weightedRecall": F.col("wr") / n, "weightedPrecision": F.col("wp") / n,
        "accuracy": F.col("tp") / n, "precisionByLabel": F.col("pbl"), "recallByLabel": F.col("rbl"),
        "fMeasureByLabel": F.col("fbl"),
    }
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"))
                                  for k, v in values.items()]))
    return (agg.select(*by, stacked.alias("m"))
            .select(*by, "m.metric", F.round("m.value", digits).alias("value")))
