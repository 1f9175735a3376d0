"""Evaluation and threshold operators: Spark ML cross-checks, edge frames, properties."""

import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from cardsight.operators import evaluate, ordered, threshold


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        y = 1 if rng.random() < 0.1 else 0
        s = min(1.0, max(0.0, rng.gauss(0.65 if y else 0.35, 0.2)))
        s = round(s, 2)                      # many ties
        rows.append((i, y, s, float(s > 0.5)))
    return spark.createDataFrame(rows, "id long, y int, s double, p double")


def test_multi_metrics_match_spark_evaluator(spark, scored):
    ours = {r.metric: r.value for r in evaluate.multi_metrics(scored, "y", "p").collect()}
    df = scored.withColumn("label", F.col("y").cast("double"))
    for m in evaluate.MULTI_METRICS:
        ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="p", metricName=m)
        assert ours[m] == pytest.approx(ev.evaluate(df), abs=1e-9), m


def test_auc_matches_spark_exact_evaluator(spark, scored):
    ours = evaluate.roc_auc(scored, "y", "s").first().auc
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="s", metricName="areaUnderROC", numBins=0)
    theirs = ev.evaluate(scored.withColumn("label", F.col("y").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_balanced_accuracy_is_hard_label_auc(spark, scored):
    ours = evaluate.balanced_accuracy(scored, "y", "p").first().balanced_accuracy
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="p", metricName="areaUnderROC")
    assert ours == pytest.approx(ev.evaluate(scored.withColumn("label", F.col("y").cast("double"))), abs=1e-9)


def test_roc_curve_monotone_and_ends(spark, scored):
    pts = evaluate.roc_curve(scored, "y", "s", ranges=5).orderBy(F.desc("threshold")).collect()
    tprs, fprs = [p.tpr for p in pts], [p.fpr for p in pts]
    assert tprs == sorted(tprs) and fprs == sorted(fprs)
    assert tprs[-1] == 1.0 and fprs[-1] == 1.0


def test_running_totals_equal_single_window(spark):
    rng = random.Random(1)
    rows = [(g, float(k), rng.randint(0, 9)) for g in ("a", "b") for k in rng.sample(range(10000), 700)]
    df = spark.createDataFrame(rows, "g string, k double, v long")
    ours = ordered.running_totals(df, "k", ["v"], by=["g"], ranges=6)
    ref = df.withColumn("ref", F.sum("v").over(Window.partitionBy("g").orderBy("k")))
    bad = ours.join(ref, ["g", "k"]).where(F.col("v_cum") != F.col("ref")).count()
    assert bad == 0
    tot = {r.g: r.t for r in df.groupBy("g").agg(F.sum("v").alias("t")).collect()}
    assert all(r.v_total == tot[r.g] for r in ours.select("g", "v_total").distinct().collect())


def test_running_totals_descending_with_null_nan_keys_and_null_group(spark):
    rng = random.Random(7)
    rows = []
    for g in ("a", "b", None):
        keys = [float(k) for k in rng.sample(range(5000), 300)] + [float("nan"), None, float("inf")]
        rows += [(g, k, rng.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, "g string, k double, v long")
    ours = ordered.running_totals(df, "k", ["v"], by=["g"], descending=True, ranges=5)
    ref = df.withColumn("ref", F.sum("v").over(Window.partitionBy("g").orderBy(F.desc("k"))))
    j = ours.alias("o").join(ref.alias("r"), F.col("o.g").eqNullSafe(F.col("r.g"))
                             & F.col("o.k").eqNullSafe(F.col("r.k")))
    assert j.count() == len(rows)
    assert j.where(F.col("o.v_cum") != F.col("r.ref")).count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 16, 40])
def test_running_totals_on_any_number_of_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot"] * 20 + ["b", "c", None]), float(k), rng.randint(0, 9) or None, rng.random()) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, k double, v long, w double").repartition(5)
    got = {r.k: r for r in ordered.running_totals(df, "k", ["v", "w"], by=["g"], ranges=ranges).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine, v, w = [r for r in rows if r[0] == g], 0, 0.0
        for r in mine:
            v, w = v + (r[2] or 0), w + r[3]
            assert got[r[1]].v_cum == v and got[r[1]].w_cum == pytest.approx(w) and got[r[1]].v == r[2]
        assert {got[r[1]].v_total for r in mine} == {v}
    assert ordered.running_totals(df.limit(0), "k", ["v"], by=["g"], ranges=ranges).count() == 0


def test_running_totals_read_in_fewer_tasks_and_with_a_struct_key(spark):
    df = spark.range(3000).select(F.struct((F.col("id") % 7).alias("a"), F.col("id").alias("b")).alias("k"), F.lit(1).cast("long").alias("v"))
    out = ordered.running_totals(df, "k", ["v"], ranges=9).coalesce(2).collect()
    assert [r.v_cum for r in sorted(out, key=lambda r: (r.k.a, r.k.b))] == list(range(1, 3001))


@pytest.mark.parametrize("setting", ["spark.sql.exchange.reuse", "spark.sql.adaptive.enabled", "spark.sql.execution.reuseSubquery"])
def test_running_totals_do_not_rest_on_reuse(spark, setting):
    """Ranges are the same in every copy of the plan, also where nothing is reused."""
    df = spark.range(20000).select((F.col("id") * 7919 % 20011).cast("double").alias("k"), F.lit(1).cast("long").alias("v"))
    spark.conf.set(setting, "false")
    try:
        out = ordered.running_totals(df.repartition(6), "k", ["v"], ranges=6).collect()
        assert [r.v_cum for r in sorted(out, key=lambda r: r.k)] == list(range(1, 20001))
    finally:
        spark.conf.unset(setting)


def test_ranges_are_about_equal_and_follow_from_the_key(spark):
    df = spark.range(50000).select(F.exp(F.col("id") / 5000).alias("k"), F.lit(1).cast("long").alias("v"))
    cuts = [ordered.cut_points(df.repartition(p), "k", 20).first().cuts for p in (1, 9)]
    assert cuts[0] == cuts[1] == sorted(set(cuts[0])) and len(cuts[0]) == 19
    sizes = df.withColumn("_cuts", F.array(*map(F.lit, cuts[0]))).selectExpr(f"{ordered.range_of('k', 20)} AS r").groupBy("r").count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 3 * 2500
    want = {r: sum(c < math.exp(r / 5000) for c in cuts[0]) for r in (0, 777, 25000, 49999)}
    assert {r: df.where(F.col("k") == F.exp(F.lit(r / 5000))).withColumn("_cuts", F.array(*map(F.lit, cuts[0])))
            .selectExpr(f"{ordered.range_of('k', 20)} AS r").first().r for r in want} == want


def test_sweep_matches_direct_counts(spark, scored):
    sweep = threshold.threshold_sweep(scored, "y", "s").orderBy("threshold_index").collect()
    assert len(sweep) == 36
    for row in sweep[::7]:
        t = 0.1 + 0.025 * row.threshold_index
        tp = scored.where((F.col("s") > t) & (F.col("y") == 1)).count()
        fp = scored.where((F.col("s") > t) & (F.col("y") == 0)).count()
        assert (row.tp, row.fp) == (tp, fp)
    tps = [r.tp for r in sweep]
    assert tps == sorted(tps, reverse=True)


def test_sweep_matches_evaluator_at_each_threshold(spark, scored):
    df = scored.withColumn("label", F.col("y").cast("double"))
    sweep = {r.threshold_index: r for r in threshold.threshold_sweep(scored, "y", "s").collect()}
    for i in (0, 12, 20, 35):
        t = 0.1 + 0.025 * i
        d = df.withColumn("pd", (F.col("s") > t).cast("double"))
        for m, col in (("weightedPrecision", "weighted_precision"), ("weightedRecall", "weighted_recall"),
                       ("f1", "weighted_f1")):
            ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="pd", metricName=m)
            assert getattr(sweep[i], col) == pytest.approx(ev.evaluate(d), abs=1e-9)


def test_cutoffs_on_exact_boundaries(spark):
    # scores exactly on a cut-off are not above it (strict >)
    df = spark.createDataFrame([(0.125,), (0.1,), (0.0,), (1.0,), (0.6,)], "s double")
    ks = [r.k for r in df.select(threshold.cutoffs_below(F.col("s"), 0.1, 0.025, 36).alias("k")).collect()]
    direct = [sum(1 for i in range(36) if s > 0.1 + 0.025 * i) for s in (0.125, 0.1, 0.0, 1.0, 0.6)]
    assert ks == direct


def test_best_threshold_first_wins_ties(spark):
    sweep = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9)], "threshold_index int, weighted_precision double")
    assert threshold.best_threshold(sweep).first().threshold_index == 1


def test_report_single_class_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0), (0, 1.0)], "y int, p double")
    rows = {r.row: r for r in evaluate.classification_report(df, "y", "p", zero_division=1.0).collect()}
    assert rows["1.0"].support == 0 and rows["1.0"].recall == 1.0 and rows["1.0"].precision == 0.0
    assert rows["accuracy"].f1_score == pytest.approx(2 / 3)


def test_confusion_dense_sums_to_n(spark, scored):
    cells = evaluate.confusion(scored, "y", "p", classes=[0, 1]).collect()
    assert len(cells) == 4 and sum(c["count"] for c in cells) == 4000


def test_empty_input(spark):
    empty = spark.createDataFrame([], "y int, s double, p double")
    sweep = threshold.threshold_sweep(empty, "y", "s").collect()   # one row per cut-off, all zero
    assert len(sweep) == 36 and all(r.tp == 0 and r.fp == 0 and r.weighted_precision == 0.0 for r in sweep)
    auc = evaluate.roc_auc(empty, "y", "s").collect()                # global aggregate: one NULL row
    assert len(auc) == 1 and auc[0].auc is None and auc[0].positives in (None, 0)


def test_zero_division_per_model(spark):
    # class 1 occurs but is never predicted: its precision is 0/0
    rows = [(m, y, 0.0) for m in ("RandomForest", "GBT") for y in (0, 1)]
    df = spark.createDataFrame(rows, "model string, y int, p double")
    out = {(r.model, r.row): r for r in evaluate.classification_report(
        df, "y", "p", by=["model"], zero_division=evaluate.zero_division_by_model()).collect()}
    assert out[("RandomForest", "1.0")].precision == 1.0
    assert out[("GBT", "1.0")].precision == 0.0
    assert out[("GBT", "1.0")].recall == 0.0 and out[("RandomForest", "1.0")].recall == 0.0


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.2), ("a", 1, 0.1)], "g string, y int, s double")
    df = df.withColumn("p", (F.col("s") > 0.5).cast("double"))
    rep = evaluate.classification_report(df, "y", "p", by=["g"]).where(F.col("g").isNull()).collect()
    assert {r.row for r in rep} == {"0.0", "1.0", "accuracy", "macro avg", "weighted avg"}
    assert [r for r in rep if r.row == "accuracy"][0].f1_score == 1.0
    sweep = threshold.threshold_sweep(df, "y", "s", by=["g"]).where(F.col("g").isNull()).collect()
    assert len(sweep) == 36 and max(r.tp for r in sweep) == 1
    cells = evaluate.confusion(df, "y", "p", by=["g"], classes=[0, 1]).where(F.col("g").isNull()).collect()
    assert sum(c["count"] for c in cells) == 2


def test_confusion_keeps_cells_outside_class_list(spark):
    df = spark.createDataFrame([(0, 0.0), (2, 1.0)], "y int, p double")
    cells = {(r.actual, r.predicted): r["count"] for r in evaluate.confusion(df, "y", "p", classes=[0, 1]).collect()}
    assert cells[(2.0, 1.0)] == 1 and cells[(0.0, 0.0)] == 1 and len(cells) == 5


def test_binned_auc_close_to_exact(spark):
    rng = random.Random(11)
    rows = [(int(rng.random() < 0.2),) for _ in range(3000)]
    rows = [(y, min(1.0, max(0.0, rng.gauss(0.6 if y else 0.4, 0.2)))) for (y,) in rows]
    df = spark.createDataFrame(rows, "y int, s double")
    exact = evaluate.roc_auc(df, "y", "s").first().auc
    binned = evaluate.roc_auc(df, "y", "s", bins=1000).first().auc
    assert binned == pytest.approx(exact, abs=1e-3)
    assert evaluate.roc_curve(df, "y", "s", bins=100).count() <= 101
