"""Queries: learners, scoring, persistence and tuning.

The learners train with the published tuned settings and the search with the published
space. A fitted model differs in its last digits between engines, so the oracles cover what
is exact: which rows are scored, that probabilities and decisions agree, supports, trials.
One fitted pipeline a session and folder serves all queries that only read it.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, features, models, sampling, threshold, tune
from ..session import cached, scratch_path
from ..sources import files
from ..sources.models import OWN_STAGES, load_foreign, load_model, save_model, stage_metadata
from ..streaming import scoring
from .q_features import CATEGORICAL, M, NUMERIC, split_model_frame
from .q_prepare import SAMPLE_FRACTIONS, SAMPLE_SEED
from .registry import query

LABEL = "is_fraud"
CUT = 0.6
_FITTED: dict[tuple, object] = {}

# A row is scored if every log exists (the assembler's ``skip``).
_SCORED = " AND ".join(f"{c} > 0" for c in NUMERIC)
_SCORED_ROWS = f"{M}, s AS (SELECT * FROM m WHERE portion = 'test' AND {_SCORED})"


def train_test(spark, sf_dir):
    train, test = split_model_frame(spark, sf_dir)
    sample = sampling.stratified_sample(train, LABEL, SAMPLE_FRACTIONS, SAMPLE_SEED, key="txn_id")
    return sample, test


def stages(use_pairwise: bool = True):
    return features.feature_stages(CATEGORICAL, NUMERIC, use_pairwise=use_pairwise)


def tuned_model(spark, sf_dir):
    """The tuned pipeline, fitted once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _FITTED.clear()     # one folder's models at a time
        _FITTED[key] = models.fit_pipeline(train_test(spark, sf_dir)[0], stages() + [models.gbt(LABEL, **models.TUNED_GBT)])
    return _FITTED[key]


def in_range(c):
    return F.col(c).isNotNull() & F.col(c).between(0.0, 1.0)


@query("fit_score", f"""{_SCORED_ROWS}
SELECT txn_id, is_fraud, TRUE AS p1_in_range, TRUE AS prediction_agrees FROM s""")
def q_fit_score(spark, sf_dir):
    out = models.score(tuned_model(spark, sf_dir), train_test(spark, sf_dir)[1], LABEL, keep=["txn_id"])
    return out.select("txn_id", LABEL, in_range("p1").alias("p1_in_range"),
                      (F.col("prediction") == (F.col("p1") > 0.5).cast("double")).alias("prediction_agrees"))


@query("score_audit", f"""{M} SELECT portion, count(*) AS rows, count(*) FILTER (WHERE {_SCORED}) AS scored,
       count(*) FILTER (WHERE NOT ({_SCORED})) AS skipped FROM m WHERE portion = 'test' GROUP BY portion""")
def q_score_audit(spark, sf_dir):
    """How many test rows are scored, and how many the assembler's ``skip`` leaves out."""
    test = train_test(spark, sf_dir)[1]
    counts = features.assembler_audit(test, stages()).groupBy().pivot("column", ["__rows__", "__any__"]).agg(F.first("n_invalid"))
    return counts.select(F.lit("test").alias("portion"), F.col("__rows__").alias("rows"),
                         (F.col("__rows__") - F.col("__any__")).alias("scored"), F.col("__any__").alias("skipped"))


_IMPORTANCE_NAMES = [*NUMERIC, *[f"ln_{c}" for c in NUMERIC], *features.pairwise_names(NUMERIC), *CATEGORICAL]


@query("feature_importance", "SELECT feature, TRUE AS in_range FROM (VALUES " + ", ".join(
    f"('{n}')" for n in _IMPORTANCE_NAMES) + ") AS t(feature)")
def q_feature_importance(spark, sf_dir):
    imp = models.feature_importance(tuned_model(spark, sf_dir), train_test(spark, sf_dir)[0], fold_one_hot=True)
    return imp.select("feature", in_range("importance").alias("in_range"))


_MODELS = ("GBTClassifier", "RandomForest", "LogisticRegression")


@query("model_compare", f"""{_SCORED_ROWS}, names(model) AS (VALUES {', '.join(f"('{n}')" for n in _MODELS)})
SELECT model, CAST(is_fraud AS VARCHAR) AS measure, CAST(count(*) AS BIGINT) AS value FROM s, names GROUP BY model, is_fraud
UNION ALL SELECT model, 'auc_above_half', 1 FROM names
UNION ALL SELECT model, 'balanced_accuracy_above_half', 1 FROM names""")
def q_model_compare(spark, sf_dir):
    """Three learners with published or Spark's default settings on shared features."""
    train, test = train_test(spark, sf_dir)
    fitted = models.fit_models(train, stages(), {
        "GBTClassifier": models.gbt(LABEL, **models.TUNED_GBT),
        "RandomForest": models.random_forest(LABEL),
        "LogisticRegression": models.logistic(LABEL),
    })
    preds = models.scored_once(fitted, test, LABEL)
    report = evaluate.classification_report(preds, LABEL, "prediction", by=["model"],
                                            zero_division=evaluate.zero_division_by_model())
    auc = evaluate.roc_auc(preds, LABEL, "p1", by=["model"])
    hard = evaluate.balanced_accuracy(preds, LABEL, "prediction", by=["model"])
    support = report.where(F.col("row").isin("0.0", "1.0")).select(
        "model", F.substring("row", 1, 1).alias("measure"), F.col("support").cast("bigint").alias("value"))
    above = lambda df, c: df.select("model", F.lit(f"{c}_above_half").alias("measure"),
                                    (F.col(c) > 0.5).cast("bigint").alias("value"))
    return support.unionByName(above(auc, "auc")).unionByName(above(hard, "balanced_accuracy"))


@query("model_report", f"""{M}, t AS (SELECT portion, is_fraud FROM m WHERE portion = 'test' AND {_SCORED})
SELECT portion, CAST(is_fraud AS VARCHAR) AS measure, CAST(count(*) AS BIGINT) AS value FROM t GROUP BY portion, is_fraud
UNION ALL SELECT * FROM (VALUES ('train', 'auc_above_half', 1), ('test', 'auc_above_half', 1)) AS v(portion, measure, value)""")
def q_model_report(spark, sf_dir):
    """Report and AUC of one fitted model on its training sample and on the test portion; the
    supports of the test portion are exact."""
    train, test = train_test(spark, sf_dir)
    rows = models.score(tuned_model(spark, sf_dir), train.unionByName(test), LABEL, keep=["portion"])
    report = evaluate.classification_report(rows, LABEL, "prediction", by=["portion"])
    auc = evaluate.roc_auc(rows, LABEL, "p1", by=["portion"])
    support = report.where("portion = 'test' and row in ('0.0', '1.0')").select(
        "portion", F.substring("row", 1, 1).alias("measure"), F.col("support").cast("bigint").alias("value"))
    return support.unionByName(auc.select("portion", F.lit("auc_above_half").alias("measure"),
                                          (F.col("auc") > 0.5).cast("bigint").alias("value")))


def two_models(spark, sf_dir):
    """The tuned pipeline and a logistic regression on the same fitted feature stages."""
    key = (spark.sparkContext.applicationId, sf_dir, "logistic")
    tuned = tuned_model(spark, sf_dir)
    if key not in _FITTED:
        feats = PipelineModel(tuned.stages[:-1])
        with cached(models.training_rows(feats, train_test(spark, sf_dir)[0], [LABEL, features.FEATURES], features.FEATURES)) as rows:
            _FITTED[key] = PipelineModel(tuned.stages[:-1] + [models.logistic(LABEL).fit(rows)])
    return {"GBTClassifier": tuned, "LogisticRegression": _FITTED[key]}


@query("model_roc_curve", f"""{_SCORED_ROWS}, names(model) AS (VALUES ('GBTClassifier'), ('LogisticRegression'))
SELECT model, CAST(count(*) FILTER (WHERE is_fraud = 1) AS BIGINT) AS positives,
       CAST(count(*) FILTER (WHERE is_fraud <> 1) AS BIGINT) AS negatives, TRUE AS rises FROM s, names GROUP BY model""")
def q_model_roc_curve(spark, sf_dir):
    """ROC curves of two fitted models: they end at all positives and negatives, and never fall - neither
    from point to point inside a hundredth of the scores nor from one hundredth to the next."""
    rows = models.score_models(two_models(spark, sf_dir), train_test(spark, sf_dir)[1], LABEL)
    curve = evaluate.roc_curve(rows, LABEL, "p1", by=["model"]).withColumn("part", F.floor(F.col("threshold") * 100))
    inside, along = Window.partitionBy("model", "part").orderBy(F.desc("threshold")), Window.partitionBy("model").orderBy(F.desc("part"))
    rises = lambda w, least, most: F.coalesce(F.col(least) >= F.lag(most).over(w), F.lit(True))
    points = curve.withColumn("ok", rises(inside, "tp", "tp") & rises(inside, "fp", "fp") & F.col("tpr").between(0, 1) & F.col("fpr").between(0, 1))
    parts = points.groupBy("model", "part").agg(F.bool_and("ok").alias("ok"), *[
        f(c).alias(f"{n}_{c}") for c in ("tp", "fp") for n, f in (("lo", F.min), ("hi", F.max))])
    parts = parts.withColumn("ok", F.col("ok") & rises(along, "lo_tp", "hi_tp") & rises(along, "lo_fp", "hi_fp"))
    return parts.groupBy("model").agg(F.max("hi_tp").alias("positives"), F.max("hi_fp").alias("negatives"), F.bool_and("ok").alias("rises"))


@query("model_threshold", f"""{M}, s AS (SELECT * FROM m WHERE portion = 'test' AND {_SCORED})
SELECT 'sweep' AS part, {threshold.SWEEP_COUNT} AS rows, count(*) AS support FROM s
UNION ALL SELECT 'report', 5, count(*) FROM s""")
def q_model_threshold(spark, sf_dir):
    """Threshold sweep and the report at a fixed cut-off on a model's probabilities."""
    rows = models.score(tuned_model(spark, sf_dir), train_test(spark, sf_dir)[1], LABEL)
    sweep = threshold.threshold_sweep(rows, LABEL, "p1")
    report = threshold.score_at_threshold(rows, LABEL, "p1", CUT)
    total = F.max(F.when(F.col("row") == "accuracy", F.col("support"))).cast("bigint")
    return sweep.agg(F.lit("sweep").alias("part"), F.count(F.lit(1)).cast("int").alias("rows"),
                     F.max(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).cast("bigint").alias("support")) \
        .unionByName(report.agg(F.lit("report").alias("part"), F.count(F.lit(1)).cast("int").alias("rows"), total.alias("support")))


@query("model_roundtrip", f"{_SCORED_ROWS} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM s")
def q_model_roundtrip(spark, sf_dir):
    """Saved and loaded pipelines score the same rows alike (one scan, no join)."""
    model = tuned_model(spark, sf_dir)
    loaded = load_model(save_model(model, scratch_path(spark, "pipeline")))
    both = models.score_side_by_side({"before": model, "after": loaded}, train_test(spark, sf_dir)[1])
    return both.agg(F.count(F.lit(1)).alias("rows"),
                    F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("differing"))


@query("model_foreign", f"{_SCORED_ROWS} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM s")
def q_model_foreign(spark, sf_dir):
    """A pipeline whose custom stages are stored under another module path, with other parameter names and
    output names spelt out, loads and scores like ours."""
    model = tuned_model(spark, sf_dir)
    path = save_model(model, scratch_path(spark, "foreign"))
    for i, stage in enumerate(model.stages):
        if type(stage).__name__ in OWN_STAGES:
            at = f"{path}/stages/{i}_{stage.uid}"
            stored = stage_metadata(spark, at)
            names = {"inputCols": "input_cols", "outputCols": "output_cols"} if isinstance(stage, features.LogTransformer) else {}
            given = {"inputCols": stage.getInputCols(), "outputCols": stage.getOutputCols()}
            stored |= {"class": f"elsewhere.stages.{type(stage).__name__}", "defaultParamMap": {names.get(k, k): None for k in given},
                       "paramMap": {names.get(k, k): v for k, v in given.items()}}
            spark.createDataFrame([(json.dumps(stored),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/metadata")
    both = models.score_side_by_side({"before": model, "after": load_foreign(spark, path)}, train_test(spark, sf_dir)[1])
    return both.agg(F.count(F.lit(1)).alias("rows"),
                    F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("differing"))


_METRICS = ", ".join(f"('{m}')" for m in evaluate.MULTI_METRICS)


@query("cv_metrics", f"SELECT metric, CAST(3 AS BIGINT) AS folds, TRUE AS in_range FROM (VALUES {_METRICS}) AS t(metric)")
def q_cv_metrics(spark, sf_dir):
    train, _ = train_test(spark, sf_dir)
    pipe = Pipeline(stages=stages() + [models.gbt(LABEL, **models.TUNED_GBT)])
    out = tune.cross_validate(train, pipe, LABEL, k=3, seed=7, parallelism=3)
    return out.select("metric", "folds", in_range("mean").alias("in_range"))


@query("refit_metrics", f"SELECT metric, TRUE AS in_range FROM (VALUES {_METRICS}) AS t(metric)")
def q_refit_metrics(spark, sf_dir):
    train, _ = train_test(spark, sf_dir)
    pipe = Pipeline(stages=stages() + [models.gbt(LABEL, **models.TUNED_GBT)])
    return tune.refit_metrics(train, pipe, LABEL).select("metric", in_range("value").alias("in_range"))


def _spark_metrics(preds, weights_label: float = 0.0) -> dict[str, float]:
    """The seven metrics by Spark's own evaluator, one job each."""
    ev = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="prediction", metricLabel=weights_label)
    rows = preds.withColumn("_y", F.col(LABEL).cast("double"))
    return {m: ev.setMetricName(m).evaluate(rows) for m in evaluate.MULTI_METRICS}


def _differing(spark, ours: dict[str, float], theirs: dict[str, float]):
    rows = [(m, int(abs(ours[m] - theirs[m]) > 1e-9)) for m in evaluate.MULTI_METRICS]
    return spark.createDataFrame(rows, "metric string, differing int")


@query("cv_values", f"SELECT metric, 0 AS differing FROM (VALUES {_METRICS}) AS t(metric)")
def q_cv_values(spark, sf_dir):
    """Cross-validated metrics against Spark's evaluator on the same held-out predictions, fold by fold."""
    train, _ = train_test(spark, sf_dir)
    pipe = Pipeline(stages=stages(False) + [models.logistic(LABEL, maxIter=20)])
    with tune.fold_features(train, pipe, LABEL, k=3, seed=7) as folds, cached(folds.held_out(pipe.getStages()[-1], parallelism=3)) as held:
        each = tune.run_all(spark, [lambda i=i: _spark_metrics(held.where(F.col("fold") == i)) for i in range(3)], 3)
        ours = {r.metric: r["mean"] for r in tune.fold_metrics(held, LABEL).collect()}
    return _differing(spark, ours, {m: sum(e[m] for e in each) / 3 for m in evaluate.MULTI_METRICS})


@query("refit_values", f"SELECT metric, 0 AS differing FROM (VALUES {_METRICS}) AS t(metric)")
def q_refit_values(spark, sf_dir):
    """Metrics of a refit on its own training data against Spark's evaluator."""
    train, _ = train_test(spark, sf_dir)
    pipe = Pipeline(stages=stages(False) + [models.logistic(LABEL, maxIter=20)])
    ours = {r.metric: r.value for r in tune.refit_metrics(train, pipe, LABEL).collect()}
    with cached(pipe.fit(train).transform(train).select(LABEL, "prediction")) as rows:
        return _differing(spark, ours, _spark_metrics(rows))


@query("importance_values", "SELECT feature, FALSE AS differs FROM (VALUES " + ", ".join(f"('{n}')" for n in _IMPORTANCE_NAMES) + ") AS t(feature)")
def q_importance_values(spark, sf_dir):
    """Feature importances against the ones that follow from the saved trees: every split adds its gain times
    the weight of its rows to its feature, and the sums are scaled to one."""
    train, model = train_test(spark, sf_dir)[0], tuned_model(spark, sf_dir)
    path = save_model(model, scratch_path(spark, "trees"))
    last = len(model.stages) - 1
    nodes = spark.read.parquet(f"{path}/stages/{last}_{model.stages[-1].uid}/data").select("nodeData.*")
    gains = nodes.where("leftChild >= 0").groupBy(F.col("split.featureIndex").alias("_slot")).agg(F.sum(F.col("gain") * F.col("impurityStats")[0]).alias("_g"))
    named = [(i, n.split("_ohe_")[0]) for i, n in enumerate(models.slot_names(model.transform(train.limit(0))))]
    slots = spark.createDataFrame(named, "slot int, _f string")
    names = gains.join(slots, F.col("_slot") == F.col("slot")).groupBy("_f").agg(F.sum("_g").alias("_g"))
    total = names.select(F.sum("_g")).scalar()
    imp = models.feature_importance(model, train, fold_one_hot=True)
    return imp.join(names, F.col("feature") == F.col("_f"), "left").select(
        "feature", (F.abs(F.col("importance") - F.coalesce(F.col("_g") / total, F.lit(0.0))) > 1e-9).alias("differs"))


# The published search space, population and folds.
SEARCH_RANGES = {"maxDepth": [5, 10], "maxBins": [32], "stepSize": [0.05, 0.1], "maxIter": [50],
                 "subsamplingRate": [0.7, 1.0], "minInstancesPerNode": [5], "minInfoGain": [0.01]}
POPULATION = 6
SEARCH_FOLDS = 3

# The space has 8 points, fewer than two generations score: all of them, six and then two.
_SEARCH_SQL = " UNION ALL ".join(
    f"SELECT {n // POPULATION} AS generation, {n % POPULATION} AS trial, {d} AS max_depth, "
    f"CAST({s} AS DOUBLE) AS step_size, CAST({r} AS DOUBLE) AS subsampling, TRUE AS scored"
    for n, (d, s, r) in enumerate((d, s, r) for d in SEARCH_RANGES["maxDepth"] for s in SEARCH_RANGES["stepSize"]
                                  for r in SEARCH_RANGES["subsamplingRate"]))


@query("evolve_params", _SEARCH_SQL)
def q_evolve_params(spark, sf_dir):
    train, _ = train_test(spark, sf_dir)
    search = tune.EvolutionarySearch(Pipeline(stages=stages() + [models.gbt(LABEL)]), SEARCH_RANGES, LABEL, metric="f1",
                                     population=POPULATION, generations=2, folds=SEARCH_FOLDS, seed=11, parallelism=8)
    search.run(train)
    p = F.from_json("params", "maxDepth int, stepSize double, subsamplingRate double")
    return search.trial_log(spark).select(
        "generation", "trial", p["maxDepth"].alias("max_depth"), p["stepSize"].alias("step_size"),
        p["subsamplingRate"].alias("subsampling"), in_range("score").alias("scored"))


# A space of 1152 points for a budget of 12 trials, with a learner small enough to be fitted often.
WIDE_RANGES = {"maxDepth": [2, 3, 4, 5], "maxIter": [2, 3, 4], "stepSize": [0.05, 0.1, 0.2, 0.4],
               "subsamplingRate": [0.5, 0.7, 0.85, 1.0], "minInstancesPerNode": [1, 5, 20], "minInfoGain": [0.0, 0.01]}
WIDE_POPULATION, WIDE_GENERATIONS = 4, 3


@query("evolve_wide", " UNION ALL ".join(
    f"SELECT {n} AS id, {n // WIDE_POPULATION} AS generation, {n % WIDE_POPULATION} AS trial, {str(n >= WIDE_POPULATION).upper()} AS child, "
    "TRUE AS is_new, TRUE AS parents_best, TRUE AS genes_explained, TRUE AS scored, TRUE AS resumed_equal"
    for n in range(WIDE_POPULATION * WIDE_GENERATIONS)))
def q_evolve_wide(spark, sf_dir):
    """Evolution over a space larger than the budget, once in one go and once stopped after two generations
    and taken up by a new search from its state: every child descends from the two best trials before
    it, every gene is a parent's or marked as drawn anew, and both logs are the same."""
    train, _ = train_test(spark, sf_dir)
    state = scratch_path(spark, "search")

    def search(generations, path):
        s = tune.EvolutionarySearch(Pipeline(stages=stages(False) + [models.gbt(LABEL)]), WIDE_RANGES, LABEL, metric="f1",
                                    population=WIDE_POPULATION, generations=generations, folds=2, seed=5, parallelism=8, state=path)
        s.run(train)
        return s.trial_log(spark)

    straight = search(WIDE_GENERATIONS, None)
    search(WIDE_GENERATIONS - 1, state)
    resumed = search(WIDE_GENERATIONS, state)
    same = ["id", "generation", "trial", "params", "parent_1", "parent_2", "mutated", "score"]
    other = resumed.select(F.col("id").alias("_id"), F.struct(*[F.col(c) for c in same]).alias("_other"))
    both = straight.join(other, F.col("id") == F.col("_id"), "left").select(
        F.col("id").alias("_id"), F.col("parent_1").isNotNull().alias("child"), in_range("score").alias("scored"),
        F.coalesce(F.struct(*[F.col(c) for c in same]).eqNullSafe(F.col("_other")), F.lit(False)).alias("resumed_equal"))
    return tune.lineage(straight).join(both, F.col("id") == F.col("_id")).drop("_id")


@query("stream_score", f"""{_SCORED_ROWS}
SELECT txn_id, is_fraud, TRUE AS p1_in_range, TRUE AS flagged_agrees FROM s""")
def q_stream_score(spark, sf_dir):
    """The test portion arrives as a file stream and is scored by the fitted pipeline
    (Structured Streaming, available-now trigger); the sink's files are read back."""
    test = train_test(spark, sf_dir)[1]
    landing = scratch_path(spark, "stream-in")
    files.write_parquet(test, landing)
    stream = scoring.read_stream(spark, landing, test.schema, max_files_per_trigger=4)
    out = scratch_path(spark, "stream-out")
    q = scoring.write_stream(scoring.score_stream(tuned_model(spark, sf_dir), stream, threshold=CUT, keep=["txn_id", LABEL]),
                             out, available_now=True)
    scoring.run_to_completion(q)
    return spark.read.parquet(out).select(
        "txn_id", LABEL, in_range("p1").alias("p1_in_range"),
        (F.col("flagged") == (F.col("p1") > CUT).cast("double")).alias("flagged_agrees"))


