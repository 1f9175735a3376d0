"""Cross-validation and evolutionary search: seeded repeatability and edge settings."""

import random
import threading
import time

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cardsight.operators import features, models, tune


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        y = 1 if a + 0.5 * b + rng.gauss(0, 0.5) > 0.8 else 0
        rows.append((i, a, b, y))
    return spark.createDataFrame(rows, "txn_id long, a double, b double, y int").cache()


def pipe():
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="final_features"),
                            LogisticRegression(featuresCol="final_features", labelCol="y", maxIter=10)])


RANGES = {"regParam": [0.0, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}


def test_cross_validate_all_metrics(spark, data):
    out = {r.metric: r for r in tune.cross_validate(data, pipe(), "y", k=3, seed=1).collect()}
    assert set(out) == set(tune.MULTI_METRICS)
    assert all(r.folds == 3 for r in out.values())
    assert out["accuracy"].mean > 0.8
    assert out["weightedRecall"].mean == pytest.approx(out["accuracy"].mean)


def test_native_cross_validator(spark, data):
    assert tune.cross_validator_native(pipe(), data, "y", metric="accuracy", k=3, seed=1) > 0.8


def test_search_is_seeded_and_scores_a_candidate_once(spark, data):
    wide = {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.25, 0.5, 1.0]}
    runs = []
    for _ in range(2):
        s = tune.EvolutionarySearch(pipe(), wide, "y", metric="f1", population=4, generations=3, folds=2, seed=3)
        best, score = s.run(data)
        log = s.trial_log(spark).orderBy("generation", "trial").collect()
        runs.append((best, score, [(r.generation, r.trial, r.params, r.score) for r in log]))
        assert [sum(1 for r in log if r.generation == g) for g in range(3)] == [4, 4, 4]
        assert len({r.params for r in log}) == 12
    assert runs[0] == runs[1]
    assert runs[0][1] == max(r[3] for r in runs[0][2])


def test_small_grid_is_walked_in_order(spark, data):
    s = tune.EvolutionarySearch(pipe(), RANGES, "y", population=4, generations=2, folds=2, seed=9)
    s.run(data)
    log = s.trial_log(spark).collect()
    assert [(r.generation, r.trial) for r in log] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]
    assert len({r.params for r in log}) == 6


WIDE = {"regParam": [0.0, 0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.25, 0.5, 1.0], "maxIter": [2, 5, 10],
        "threshold": [0.3, 0.4, 0.5, 0.6], "fitIntercept": [True, False]}


def wide(state=None, generations=4, **kw):
    return tune.EvolutionarySearch(pipe(), WIDE, "y", population=5, generations=generations, folds=2,
                                   **{"seed": 2, "mutation_prob": 0.5, "mutations": 2, **kw}, state=state)


def test_every_child_descends_from_the_two_best_before_it(spark, data):
    s = wide()
    s.run(data)
    trials = {t.id: t for t in s.trials}
    assert len(trials) == 20 and len({t.genes for t in s.trials}) == 20
    for t in s.trials:
        earlier = sorted((e for e in s.trials if e.generation < t.generation), key=lambda e: (-e.score, e.id))
        assert t.parents == (tuple(e.id for e in earlier[:2]) if t.generation else None)
        if t.parents:
            for name, gene, a, b in zip(s.names, t.genes, *(trials[p].genes for p in t.parents)):
                assert gene in (a, b) or name in t.mutated
    assert any(t.mutated for t in s.trials) and any(t.parents and not t.mutated for t in s.trials)
    shown = tune.lineage(s.trial_log(spark)).collect()
    assert len(shown) == 20 and all(r.is_new and r.parents_best and r.genes_explained for r in shown)


def test_lineage_sees_what_is_not_so(spark):
    ok = dict(params="", mutated=[], score=0.5, error=None)
    rows = [dict(ok, id=0, generation=0, trial=0, genes={"a": 0, "b": 0}, parent_1=None, parent_2=None),
            dict(ok, id=1, generation=0, trial=1, genes={"a": 1, "b": 1}, parent_1=None, parent_2=None, score=0.7),
            dict(ok, id=2, generation=1, trial=0, genes={"a": 0, "b": 1}, parent_1=1, parent_2=0),
            dict(ok, id=3, generation=1, trial=1, genes={"a": 2, "b": 1}, parent_1=1, parent_2=0),
            dict(ok, id=4, generation=1, trial=2, genes={"a": 2, "b": 0}, parent_1=0, parent_2=1, mutated=["a"]),
            dict(ok, id=5, generation=1, trial=3, genes={"a": 1, "b": 1}, parent_1=1, parent_2=0)]
    schema = ", ".join(c for c in tune.STATE.split(", ") if c.split()[0] not in ("size", "settings"))
    log = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = {r.id: (r.is_new, r.parents_best, r.genes_explained) for r in tune.lineage(log).collect()}
    assert got == {0: (True, True, True), 1: (True, True, True), 2: (True, True, True), 3: (True, True, False),
                   4: (True, False, True), 5: (False, True, True)}


def test_search_stops_and_resumes_from_its_state(spark, data, tmp_path):
    straight = wide()
    best = straight.run(data)
    state = str(tmp_path / "search")
    wide(state, generations=2).run(data)
    # a driver lost while it wrote the third generation leaves part of it
    half = spark.createDataFrame(straight._rows(straight.trials[10:15])[:3], tune.STATE)
    half.write.parquet(f"{state}/trials/generation-000002")
    again = wide(state)
    scored = []
    again._score, score = (lambda folds, genes: scored.append(genes) or score(folds, genes)), again._score
    assert again.run(data) == best and again.trials == straight.trials
    assert len(scored) == 10 and again.best_per_generation == straight.best_per_generation
    third = wide(state)                       # finished: nothing is fitted again
    third._score = None
    assert third.run(data) == best and third.trials == straight.trials
    with pytest.raises(ValueError, match="other settings"):
        wide(state, seed=3).run(data)


def test_space_too_large_to_list(spark, data):
    huge = {"regParam": [i / 1e6 for i in range(10**6)], "elasticNetParam": [i / 1e6 for i in range(10**6)], "maxIter": list(range(1, 50))}
    s = tune.EvolutionarySearch(pipe(), huge, "y", population=3, generations=2, folds=2, seed=1)
    s.run(data)
    assert s.size == 49 * 10**12 and len(s.trials) == 6 and s.trials[-1].parents


def test_search_uses_a_space_up(spark, data):
    s = tune.EvolutionarySearch(pipe(), RANGES, "y", population=4, folds=2, seed=1)   # no number of generations
    s.run(data)
    assert len({t.genes for t in s.trials}) == 6 and [t.generation for t in s.trials] == [0] * 4 + [1] * 2


def test_search_population_one_and_zero_time(spark, data):
    s = tune.EvolutionarySearch(pipe(), RANGES, "y", population=1, generations=2, folds=2, seed=0)
    best, score = s.run(data)
    assert set(best) == set(RANGES) and score > 0
    s0 = tune.EvolutionarySearch(pipe(), RANGES, "y", population=2, time_limit_min=0.0, folds=2, seed=0)
    best0, _ = s0.run(data)                   # one generation always runs
    assert s0.trial_log(spark).count() == 2 and best0


def test_refused_parameters_are_logged_and_a_search_without_scores_fails(spark, data):
    s = tune.EvolutionarySearch(pipe(), {"regParam": [-1.0, 0.1]}, "y", population=2, generations=1, folds=2, seed=0)
    best, _ = s.run(data)
    assert best == {"regParam": 0.1}
    bad = s.trial_log(spark).where(F.col("score").isNull()).collect()
    assert len(bad) == 1 and "regParam" in bad[0].error
    with pytest.raises(RuntimeError):
        tune.EvolutionarySearch(pipe(), {"regParam": [-1.0]}, "y", population=2, folds=2).run(data)


def test_other_failures_are_raised(spark, data):
    with pytest.raises(Exception):
        tune.EvolutionarySearch(pipe(), RANGES, "no_such_label", population=2, generations=1, folds=2).run(data)


def test_nothing_stays_persisted_and_jobs_keep_their_group(spark, data):
    sc = spark.sparkContext
    before = sc._jsc.getPersistentRDDs().size()
    sc.setJobGroup("tuning", "tuning")
    try:
        tune.cross_validate(data, pipe(), "y", k=3, seed=1, parallelism=3)
        tune.EvolutionarySearch(pipe(), RANGES, "y", population=3, generations=2, folds=2, parallelism=3).run(data)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sc._jsc.getPersistentRDDs().size() == before
    assert len(sc.statusTracker().getJobIdsForGroup("tuning")) > 10


def test_parallel_search_equals_sequential(spark, data):
    out = []
    for par in (1, 3):
        s = tune.EvolutionarySearch(pipe(), RANGES, "y", population=3, generations=2, folds=2, seed=5,
                                    parallelism=par)
        out.append(s.run(data))
    assert out[0] == out[1]


def test_refit_metrics_on_training_data(spark, data):
    out = {r.metric: r.value for r in tune.refit_metrics(data, pipe(), "y").collect()}
    assert set(out) == set(tune.MULTI_METRICS) and out["accuracy"] > 0.8


def test_learners_read_even_partitions_that_follow_the_rows(spark, data, monkeypatch):
    monkeypatch.setattr(models, "PART_BYTES", 100 * 2 * models.SLOT_BYTES)      # 100 rows of two slots
    uneven = data.coalesce(1)
    feat = pipe().getStages()[0]
    rows = models.training_rows(PipelineModel([feat]), uneven, ["y", "final_features"], "final_features")
    assert rows.groupBy(F.spark_partition_id()).count().select("count").collect() == [(100,)] * 6
    again = models.training_rows(PipelineModel([feat]), uneven, ["y", "final_features"], "final_features")
    assert rows.rdd.glom().collect() == again.rdd.glom().collect()      # the same places every time
    with tune.fold_features(uneven, pipe(), "y", k=3, seed=1) as folds:
        for i, (rest, own) in enumerate(folds.parts):
            assert rest.count() + own.count() == 600
            for part in (rest, own):
                assert max(len(p) for p in part.rdd.glom().collect()) <= 100, i


def test_rows_without_vector_metadata_and_empty_tables_are_dealt_out(spark, data):
    plain = data.withColumn("v", array_to_vector(F.array("a", "b")))
    assert features.vector_size(plain, "v") == 2
    assert features.vector_size(plain.limit(0), "v") == 1
    assert models.training_rows(PipelineModel([]), plain.limit(0), ["y", "v"], "v").count() == 0


def test_predictions_for_several_evaluations_are_stored(spark, data):
    fitted = models.fit_models(data, pipe().getStages()[:1], {n: LogisticRegression(
        featuresCol="final_features", labelCol="y", maxIter=m) for n, m in (("a", 1), ("b", 5))})
    once = models.scored_once(fitted, data, "y")
    assert once.inputFiles() and set(once.inputFiles()).isdisjoint(data.inputFiles())
    cells = lambda df: sorted((r.model, r.y, r.prediction, round(r.p1, 9)) for r in df.collect())
    assert cells(once) == cells(models.score_models(fitted, data, "y"))


def test_fits_of_all_folds_share_the_threads(spark, data):
    """Folds of one candidate used to be fitted one after the other."""
    running, most, lock = set(), [0], threading.Lock()

    class Seen(LogisticRegression):
        def _fit(self, df):
            with lock:
                running.add(me := object())
                most[0] = max(most[0], len(running))
            time.sleep(0.5)
            try:
                return super()._fit(df)
            finally:
                with lock:
                    running.discard(me)

    one = Pipeline(stages=[pipe().getStages()[0], Seen(featuresCol="final_features", labelCol="y", maxIter=2)])
    s = tune.EvolutionarySearch(one, {"regParam": [0.1]}, "y", population=1, generations=1, folds=3, seed=1, parallelism=8)
    s.run(data)
    assert most[0] == 3
