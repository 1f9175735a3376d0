"""Queries: evaluation and threshold tuning on the view's deterministic scores
(I1-I8, K1-K3, B4, B7, C3). No model is needed: ``score`` = score_milli / 1000."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import above
from ..operators import evaluate, threshold
from ..sources.tables import TXN_SQL, load_txn
from .registry import query

W = f"WITH txn AS ({TXN_SQL})"

# Default cut-off of a probabilistic classifier and the reference's test cut-off.
DEFAULT_CUTOFF = 0.5
TEST_CUTOFF = 0.6

# Second deterministic scorer for multi-model queries: night-time transactions get +0.5.
_NIGHT_SQL = "(hour(trans_ts) >= 22 OR hour(trans_ts) < 4)"


def scored(spark, sf_dir, cutoff: float = DEFAULT_CUTOFF):
    txn = load_txn(spark, sf_dir)
    return txn.withColumn("prediction", above("score", cutoff))


def two_models(spark, sf_dir):
    """Each transaction scored by two models, stacked in a ``model`` column."""
    txn = load_txn(spark, sf_dir)
    is_night = (F.hour("trans_ts") >= 22) | (F.hour("trans_ts") < 4)
    night = ((F.when(is_night, 500).otherwise(0) + F.floor(F.col("score_milli") / 2)) / F.lit(1000.0))
    models = F.explode(F.array(
        F.struct(F.lit("amount").alias("model"), F.col("score").alias("s")),
        F.struct(F.lit("night").alias("model"), night.cast("double").alias("s"))))
    return txn.select("txn_id", "is_fraud", "portion", models.alias("m")) \
        .select("txn_id", "is_fraud", "portion", "m.model", F.col("m.s").alias("score"))


_TWO_MODELS_SQL = f"""{W}, models AS (
  SELECT txn_id, is_fraud, portion, 'amount' AS model, score FROM txn
  UNION ALL
  SELECT txn_id, is_fraud, portion, 'night' AS model,
         ((CASE WHEN {_NIGHT_SQL} THEN 500 ELSE 0 END) + floor(score_milli / 2)) / 1000.0::DOUBLE AS score
  FROM txn)"""


def _report_sql(source: str, pred: str, by: list[str], zero: float = 0.0) -> str:
    """Classification report in SQL over ``source`` (label is_fraud, prediction ``pred``)."""
    g = "".join(f"{c}, " for c in by)
    gb = ", ".join(by)
    on = " AND ".join([f"a.{c} = p.{c}" for c in by] + ["a.cls = p.cls"])
    using_g = "".join(f"COALESCE(a.{c}, p.{c}) AS {c}, " for c in by)
    part = f"PARTITION BY {gb}" if by else ""
    return f"""cells AS (
  SELECT {g}CAST(is_fraud AS DOUBLE) AS actual, {pred} AS predicted, count(*) AS cnt
  FROM {source} GROUP BY ALL),
a AS (SELECT {g}actual AS cls, sum(cnt) AS support, sum(CASE WHEN actual = predicted THEN cnt ELSE 0 END) AS tp
      FROM cells GROUP BY ALL),
p AS (SELECT {g}predicted AS cls, sum(cnt) AS npred FROM cells GROUP BY ALL),
pc AS (
  SELECT {using_g}COALESCE(a.cls, p.cls) AS cls, COALESCE(tp, 0) AS tp, COALESCE(support, 0) AS support,
         COALESCE(npred, 0) AS npred
  FROM a FULL OUTER JOIN p ON {on}),
m AS (
  SELECT {g}cls, support, tp,
    CASE WHEN npred = 0 THEN {zero} ELSE tp / npred END AS precision,
    CASE WHEN support = 0 THEN {zero} ELSE tp / support END AS recall,
    CASE WHEN support + npred = 0 THEN {zero} ELSE 2 * tp / (support + npred) END AS f1_score
  FROM pc),
t AS (
  SELECT {g}sum(support) AS n, sum(tp) AS tp, count(*) AS k, sum(precision) AS sp, sum(recall) AS sr,
         sum(f1_score) AS sf, sum(precision * support) AS wp, sum(recall * support) AS wr,
         sum(f1_score * support) AS wf
  FROM m {'GROUP BY ' + gb if by else ''})
SELECT {g}CAST(cls AS VARCHAR) AS "row", round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1_score, 9) AS f1_score, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT {g}'accuracy', NULL::DOUBLE, NULL::DOUBLE,
       round(CASE WHEN n = 0 THEN {zero} ELSE tp / n END, 9), CAST(n AS BIGINT) FROM t
UNION ALL SELECT {g}'macro avg', round(sp / k, 9), round(sr / k, 9), round(sf / k, 9), CAST(n AS BIGINT) FROM t
UNION ALL SELECT {g}'weighted avg', round(CASE WHEN n = 0 THEN {zero} ELSE wp / n END, 9),
       round(CASE WHEN n = 0 THEN {zero} ELSE wr / n END, 9),
       round(CASE WHEN n = 0 THEN {zero} ELSE wf / n END, 9), CAST(n AS BIGINT) FROM t"""


def _pred_sql(cutoff: float) -> str:
    return f"CAST(score > {cutoff}::DOUBLE AS DOUBLE)"


@query("confusion", f"""{W}, cells AS (
  SELECT CAST(is_fraud AS DOUBLE) AS actual, {_pred_sql(DEFAULT_CUTOFF)} AS predicted, count(*) AS cnt
  FROM txn GROUP BY ALL),
grid AS (SELECT a.v AS actual, p.v AS predicted FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) a(v),
         (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) p(v))
SELECT g.actual, g.predicted, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cells c ON g.actual = c.actual AND g.predicted = c.predicted""")
def q_confusion(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir), "is_fraud", "prediction", classes=[0, 1])


@query("hard_report", f"""{W}, test AS (SELECT * FROM txn WHERE portion = 'test'),
{_report_sql('test', _pred_sql(DEFAULT_CUTOFF), [])}""")
def q_hard_report(spark, sf_dir):
    test = scored(spark, sf_dir).where(F.col("portion") == "test").select("is_fraud", "prediction")
    return evaluate.classification_report(test, "is_fraud", "prediction")


@query("report_by_portion", f"{W}, {_report_sql('txn', _pred_sql(DEFAULT_CUTOFF), ['portion'])}")
def q_report_by_portion(spark, sf_dir):
    return evaluate.classification_report(scored(spark, sf_dir), "is_fraud", "prediction", by=["portion"])


@query("balanced_accuracy", f"""{W}, c AS (
  SELECT portion, count(*) FILTER (WHERE is_fraud = 1) AS pos, count(*) FILTER (WHERE is_fraud <> 1) AS neg,
         count(*) FILTER (WHERE is_fraud = 1 AND score > {DEFAULT_CUTOFF}::DOUBLE) AS tp,
         count(*) FILTER (WHERE is_fraud <> 1 AND NOT (score > {DEFAULT_CUTOFF}::DOUBLE)) AS tn
  FROM txn GROUP BY portion)
SELECT portion, round(CASE WHEN pos > 0 AND neg > 0 THEN (tp / pos + tn / neg) / 2 END, 9) AS balanced_accuracy
FROM c""")
def q_balanced_accuracy(spark, sf_dir):
    return evaluate.balanced_accuracy(scored(spark, sf_dir), "is_fraud", "prediction", by=["portion"])


def _auc_sql(source: str, by: list[str]) -> str:
    g = "".join(f"{c}, " for c in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"""sc AS (
  SELECT {g}score, count(*) FILTER (WHERE is_fraud = 1) AS pos, count(*) FILTER (WHERE is_fraud <> 1) AS neg
  FROM {source} WHERE score IS NOT NULL GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pos_cum FROM sc),
agg AS (SELECT {g}sum(CAST(neg AS HUGEINT) * (2 * pos_cum - pos)) AS num2, sum(pos) AS P, sum(neg) AS N
        FROM cum {'GROUP BY ' + ', '.join(by) if by else ''})
SELECT {g}round(CASE WHEN P > 0 AND N > 0 THEN CAST(num2 AS DOUBLE) / (CAST(P AS DOUBLE) * CAST(N AS DOUBLE) * 2) END, 9) AS auc,
       CAST(P AS BIGINT) AS positives, CAST(N AS BIGINT) AS negatives FROM agg"""


@query("roc_auc", f"{W}, {_auc_sql('txn', [])}")
def q_roc_auc(spark, sf_dir):
    return evaluate.roc_auc(load_txn(spark, sf_dir), "is_fraud", "score")


ROC_BINS = 100


@query("roc_auc_binned", f"""{W}, snapped AS (SELECT is_fraud, floor(score * {ROC_BINS}) / {float(ROC_BINS)} AS score FROM txn),
{_auc_sql('snapped', [])}""")
def q_roc_auc_binned(spark, sf_dir):
    """AUC with scores snapped to a grid of ``ROC_BINS`` steps: at most ``ROC_BINS + 1``
    rows per group cross the shuffle, whatever the data size."""
    return evaluate.roc_auc(load_txn(spark, sf_dir), "is_fraud", "score", bins=ROC_BINS)


@query("model_roc", f"{_TWO_MODELS_SQL}, {_auc_sql('models', ['model', 'portion'])}")
def q_model_roc(spark, sf_dir):
    return evaluate.roc_auc(two_models(spark, sf_dir), "is_fraud", "score", by=["model", "portion"])


@query("roc_curve", f"""{W}, sc AS (
  SELECT score, count(*) FILTER (WHERE is_fraud = 1) AS pos, count(*) FILTER (WHERE is_fraud <> 1) AS neg
  FROM txn WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N
        FROM sc WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(CASE WHEN P > 0 THEN tp / P END, 9) AS tpr, round(CASE WHEN N > 0 THEN fp / N END, 9) AS fpr
FROM cum""")
def q_roc_curve(spark, sf_dir):
    return evaluate.roc_curve(load_txn(spark, sf_dir), "is_fraud", "score")


@query("roc_curve_binned", f"""{W}, snapped AS (SELECT is_fraud, floor(score * {ROC_BINS}) / {float(ROC_BINS)} AS score FROM txn),
sc AS (
  SELECT score, count(*) FILTER (WHERE is_fraud = 1) AS pos, count(*) FILTER (WHERE is_fraud <> 1) AS neg
  FROM snapped WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N
        FROM sc WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(CASE WHEN P > 0 THEN tp / P END, 9) AS tpr, round(CASE WHEN N > 0 THEN fp / N END, 9) AS fpr
FROM cum""")
def q_roc_curve_binned(spark, sf_dir):
    """ROC points on a grid of ``ROC_BINS`` score steps: at most ``ROC_BINS + 1`` points."""
    return evaluate.roc_curve(load_txn(spark, sf_dir), "is_fraud", "score", bins=ROC_BINS)


def _multi_sql(source: str, pred: str, label_value: float = 0.0) -> str:
    return f"""cells AS (SELECT CAST(is_fraud AS DOUBLE) AS actual, {pred} AS predicted, count(*) AS cnt
                FROM {source} GROUP BY ALL),
a AS (SELECT actual AS cls, sum(cnt) AS support, sum(CASE WHEN actual = predicted THEN cnt ELSE 0 END) AS tp
      FROM cells GROUP BY 1),
p AS (SELECT predicted AS cls, sum(cnt) AS npred FROM cells GROUP BY 1),
pc AS (SELECT a.cls, a.support, a.tp, COALESCE(p.npred, 0) AS npred FROM a LEFT JOIN p ON a.cls = p.cls),
m AS (SELECT cls, support, tp, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS pr,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc FROM pc),
f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS fm FROM m),
t AS (SELECT sum(support) AS n, sum(tp) AS tp, sum(support * pr) AS wp, sum(support * rc) AS wr,
             sum(support * fm) AS wf,
             COALESCE(max(CASE WHEN cls = {label_value} THEN pr END), 0.0) AS pbl,
             COALESCE(max(CASE WHEN cls = {label_value} THEN rc END), 0.0) AS rbl,
             COALESCE(max(CASE WHEN cls = {label_value} THEN fm END), 0.0) AS fbl FROM f)
SELECT metric, round(value, 9) AS value FROM (
  SELECT 'f1' AS metric, wf / n AS value FROM t UNION ALL
  SELECT 'weightedRecall', wr / n FROM t UNION ALL
  SELECT 'weightedPrecision', wp / n FROM t UNION ALL
  SELECT 'accuracy', tp / n FROM t UNION ALL
  SELECT 'precisionByLabel', pbl FROM t UNION ALL
  SELECT 'recallByLabel', rbl FROM t UNION ALL
  SELECT 'fMeasureByLabel', fbl FROM t)"""


@query("multi_metrics", f"{W}, {_multi_sql('txn', _pred_sql(DEFAULT_CUTOFF))}")
def q_multi_metrics(spark, sf_dir):
    return evaluate.multi_metrics(scored(spark, sf_dir), "is_fraud", "prediction")


def _sweep_sql(source: str) -> str:
    return f"""grid AS (SELECT CAST(i AS INTEGER) AS i, {threshold.SWEEP_START}::DOUBLE + {threshold.SWEEP_STEP}::DOUBLE * CAST(i AS DOUBLE) AS t
         FROM range({threshold.SWEEP_COUNT}) r(i)),
base AS (SELECT is_fraud, score FROM {source} WHERE score IS NOT NULL AND is_fraud IS NOT NULL),
tot AS (SELECT count(*) FILTER (WHERE is_fraud = 1) AS P, count(*) FILTER (WHERE is_fraud <> 1) AS N FROM base),
c AS (SELECT g.i, g.t,
        count(b.score) FILTER (WHERE b.is_fraud = 1) AS tp, count(b.score) FILTER (WHERE b.is_fraud <> 1) AS fp
      FROM grid g LEFT JOIN base b ON b.score > g.t GROUP BY g.i, g.t),
r AS (SELECT c.i, c.t, c.tp, c.fp, tot.N - c.fp AS tn, tot.P - c.tp AS fn, tot.P, tot.N FROM c, tot),
s AS (SELECT *,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p1, CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0,
  CASE WHEN P + tp + fp = 0 THEN 0.0 ELSE 2 * tp / (P + tp + fp) END AS f1_1,
  CASE WHEN N + tn + fn = 0 THEN 0.0 ELSE 2 * tn / (N + tn + fn) END AS f1_0 FROM r)
SELECT i AS threshold_index, round(t, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
       round(CASE WHEN P + N = 0 THEN 0.0 ELSE (P * p1 + N * p0) / (P + N) END, 9) AS weighted_precision,
       round(CASE WHEN P + N = 0 THEN 0.0 ELSE (tp + tn) / (P + N) END, 9) AS weighted_recall,
       round(CASE WHEN P + N = 0 THEN 0.0 ELSE (P * f1_1 + N * f1_0) / (P + N) END, 9) AS weighted_f1
FROM s"""


@query("threshold_sweep", f"{W}, train AS (SELECT * FROM txn WHERE portion = 'train'), {_sweep_sql('train')}")
def q_threshold_sweep(spark, sf_dir):
    train = load_txn(spark, sf_dir).where(F.col("portion") == "train")
    return threshold.threshold_sweep(train, "is_fraud", "score")


@query("best_threshold", f"""SELECT * FROM (
{W}, train AS (SELECT * FROM txn WHERE portion = 'train'), {_sweep_sql('train')}
) sweep ORDER BY weighted_precision DESC, threshold_index ASC LIMIT 1""")
def q_best_threshold(spark, sf_dir):
    train = load_txn(spark, sf_dir).where(F.col("portion") == "train")
    return threshold.best_threshold(threshold.threshold_sweep(train, "is_fraud", "score"), "precision")


@query("score_at_threshold", f"""{W}, test AS (SELECT * FROM txn WHERE portion = 'test'),
{_report_sql('test', _pred_sql(TEST_CUTOFF), [])}""")
def q_score_at_threshold(spark, sf_dir):
    test = load_txn(spark, sf_dir).where(F.col("portion") == "test")
    return threshold.score_at_threshold(test, "is_fraud", "score", TEST_CUTOFF)
