"""Cross-validation and evolutionary parameter search (K4-K6).

Folds come from a hash of (seed, key), so they are the same on any layout and after any
retry. Feature stages do not depend on a trial's parameters: they are fitted once a fold,
and the label and feature vector of every fold are kept while trials share them. Held-out
predictions of all folds are evaluated in one grouped aggregation, for every metric at
once. The search loop is on the driver (it holds parameter sets and scores); each trial is
a set of Spark jobs, run in threads that keep the caller's job group and scheduler pool.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import math
import random
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..session import cached
from .evaluate import MULTI_METRICS, multi_metrics
from .features import vector_size
from .models import parts_for, training_rows
from .sampling import assign_folds


def run_all(spark, jobs: list[Callable], parallelism: int = 1) -> list:
    """Results of ``jobs``, at most ``parallelism`` at a time, in threads that inherit the job
    group, description and pool of the caller."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


class Folds:
    """Label and features of the k training and held-out portions, shared by all trials; ``tasks`` of a fit's pass."""

    def __init__(self, parts: list[tuple[DataFrame, DataFrame]], label: str, tasks: int = 1):
        self.parts, self.label, self.tasks = parts, label, tasks
        self.gate = contextlib.nullcontext()

    def share(self, parallelism: int) -> None:
        """From now on the fits of all callers together run at most ``parallelism`` at a time, and no more than keep
        the cores busy: each holds its own copy of its rows, so fits with tasks for all cores run three at a time."""
        cores = self.parts[0][0].sparkSession.sparkContext.defaultParallelism
        self.gate = threading.BoundedSemaphore(min(parallelism, max(3, -(-3 * cores // self.tasks))))

    def held_out(self, learner: Estimator, prediction: str = "prediction", parallelism: int = 1) -> DataFrame:
        """(fold, label, prediction): each fold's rows, predicted by the learner fitted on the others."""
        def fit(train: DataFrame):
            with self.gate:
                return learner.fit(train)

        spark = self.parts[0][0].sparkSession
        fitted = run_all(spark, [lambda t=train: fit(t) for train, _ in self.parts], parallelism)
        frames = [model.transform(held).select(F.lit(i).alias("fold"), F.col(self.label), F.col(prediction))
                  for i, (model, (_, held)) in enumerate(zip(fitted, self.parts))]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


@contextlib.contextmanager
def fold_features(train: DataFrame, pipeline: Pipeline, label: str, k: int = 3, seed: int = 0,
                  key: str = "txn_id") -> Iterator[Folds]:
    """Fit and apply all stages but the last once a fold; everything kept is released at the end."""
    stages = pipeline.getStages()
    features, learner = Pipeline(stages=stages[:-1]), stages[-1]
    vector = learner.getOrDefault(learner.featuresCol)
    with contextlib.ExitStack() as held:
        folded = held.enter_context(cached(assign_folds(train, k, seed, key, column="_fold")))
        rows = {r["_fold"]: r["count"] for r in folded.groupBy("_fold").count().collect()}     # k rows at most
        parts = []
        for i in range(k):
            own = rows.get(i, 0)
            model = features.fit(folded.where(F.col("_fold") != i))
            parts.append(tuple(held.enter_context(cached(training_rows(model, folded.where(which).drop("_fold"), [label, vector], vector, n)))
                               for which, n in ((F.col("_fold") != i, sum(rows.values()) - own), (F.col("_fold") == i, own))))
        yield Folds(parts, label, max(parts_for(sum(rows.values()) - rows.get(i, 0), vector_size(parts[i][0], vector)) for i in range(k)))


def fold_metrics(preds: DataFrame, label: str, metric_label: float = 0.0) -> DataFrame:
    """(metric, mean, std, folds) over the folds of held-out predictions."""
    per_fold = multi_metrics(preds, label, "prediction", by=["fold"], metric_label=metric_label)
    return per_fold.groupBy("metric").agg(
        F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_samp("value"), 9).alias("std"),
        F.count(F.lit(1)).alias("folds"))


def cross_validate(train: DataFrame, pipeline: Pipeline, label: str, k: int = 3, seed: int = 0,
                   key: str = "txn_id", metric_label: float = 0.0, parallelism: int = 1) -> DataFrame:
    """k-fold CV for all seven multiclass metrics at once (K4, K5).

    Output (metric, mean, std, folds): the mean over folds of each held-out metric, not the
    refit model's score on its own training data. The seven rows are computed here, so that
    the folds' data can be released.
    """
    with fold_features(train, pipeline, label, k, seed, key) as folds:
        out = fold_metrics(folds.held_out(pipeline.getStages()[-1], parallelism=parallelism), label, metric_label)
        return train.sparkSession.createDataFrame(out.collect(), out.schema)   # one row a metric


def refit_metrics(train: DataFrame, pipeline: Pipeline, label: str, metric_label: float = 0.0) -> DataFrame:
    """All seven metrics of the pipeline refitted on ``train`` and scored on ``train``
    itself (the optimistic figure the refit best model reports): one feature fit, one
    learner fit, one aggregate, whatever the number of metrics. Output (metric, value)."""
    stages = pipeline.getStages()
    learner = stages[-1]
    features = Pipeline(stages=stages[:-1]).fit(train)
    vector = learner.getOrDefault(learner.featuresCol)
    with cached(training_rows(features, train, [label, vector], vector)) as rows:
        out = multi_metrics(learner.fit(rows).transform(rows), label, "prediction", metric_label=metric_label)
        return train.sparkSession.createDataFrame(out.collect(), out.schema)   # one row a metric


def cross_validator_native(pipeline: Pipeline, train: DataFrame, label: str, metric: str = "f1",
                           k: int = 3, seed: int = 0, parallelism: int = 1) -> float:
    """Spark's ``CrossValidator`` with an empty grid (one parameter map): mean held-out
    metric. Its folds come from ``rand(seed)`` and so depend on the partition layout."""
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=pipeline, evaluator=ev, estimatorParamMaps=ParamGridBuilder().build(),
                        numFolds=k, seed=seed, parallelism=parallelism)
    return float(cv.fit(train).avgMetrics[0])


class Trial(NamedTuple):
    """One scored candidate: where it stands, its genes (positions in the value lists), the trials it
    descends from (None: drawn at random or listed), and which parameters were drawn anew."""

    id: int
    generation: int
    trial: int
    genes: tuple[int, ...]
    parents: tuple[int, int] | None
    mutated: tuple[str, ...]
    score: float | None
    error: str | None


STATE = ("id int, generation int, trial int, size int, genes map<string,int>, params string, parent_1 int, parent_2 int, "
         "mutated array<string>, score double, error string, settings string")


class EvolutionarySearch:
    """Evolutionary search over a discrete parameter space (K6).

    A candidate gives each parameter a position in its list of values; the space is never listed, so it
    may be of any size. A generation scores ``population`` candidates that were not scored before, by the
    mean held-out ``metric`` over the folds. If the budget (population times generations) covers the
    space, the generations walk through it in order. Otherwise the first generation is drawn at random
    and each later one descends from the two best trials so far: children are made in pairs, for each
    parameter a coin says which child takes it from which parent, and with ``mutation_prob`` up to
    ``mutations`` parameters of a child are drawn anew. A child that was scored already has further
    parameters drawn anew until it was not. The log has every child's parents and the parameters drawn anew.

    Ends when the space is used up, when the best score reaches ``score_limit``, after ``generations``
    generations, or after ``time_limit_min`` minutes (None: no limit; checked between generations).
    Parameters the learner refuses are logged with their error and rank last; any other failure is
    raised, and so is a search without a single score. All draws happen on the driver from (seed,
    generation), so results depend neither on ``parallelism`` nor on where a search was stopped.

    With ``state`` - a path in storage that outlives the driver - every finished generation is written
    there as a Parquet folder. A search that finds generations in its ``state`` takes them as they are
    and goes on after the last complete one; a folder left incomplete by a lost driver is done again. A
    state of other settings than this search's is refused.
    """

    def __init__(self, pipeline: Pipeline, ranges: dict[str, list], label: str, metric: str = "f1",
                 population: int = 6, generations: int | None = None, score_limit: float = 1.0,
                 time_limit_min: float | None = None, mutation_prob: float = 0.1, mutations: int = 1,
                 folds: int = 5, seed: int = 0, key: str = "txn_id", parallelism: int = 1, state: str | None = None):
        if population < 1:
            raise ValueError("population must be >= 1")
        if metric not in MULTI_METRICS:
            raise ValueError(f"metric must be one of {MULTI_METRICS}")
        self.pipeline, self.label, self.metric = pipeline, label, metric
        self.names, self.values = list(ranges), [list(v) for v in ranges.values()]
        self.size = math.prod(len(v) for v in self.values)
        self.population, self.generations = population, generations
        self.score_limit, self.time_limit_min = score_limit, time_limit_min
        self.mutation_prob, self.mutations, self.folds = mutation_prob, mutations, folds
        self.seed, self.key, self.parallelism = seed, key, max(1, parallelism)
        self.state = state.rstrip("/") if state else None
        self.walk = generations is not None and population * generations >= self.size
        self.settings = json.dumps([ranges, label, metric, population, mutation_prob, mutations, folds, seed, key, self.walk],
                                   default=str)
        self.trials: list[Trial] = []
        self.best_per_generation: list[float] = []

    # ------------------------------------------------------------ candidates

    def params(self, genes: tuple[int, ...]) -> dict:
        return {n: v[g] for n, v, g in zip(self.names, self.values, genes)}

    def ranked(self) -> list[Trial]:
        """Scored trials, best first; the earlier of equal ones."""
        return sorted((t for t in self.trials if t.score is not None), key=lambda t: (-t.score, t.id))

    def _first_new(self, seen: set) -> tuple[int, ...]:
        return next(g for g in itertools.product(*[range(len(v)) for v in self.values]) if g not in seen)

    def _renew(self, rng: random.Random, genes: list[int], seen: set) -> tuple[list[int], set[int]]:
        """``genes`` with parameters drawn anew, one more at a time, until the candidate is new."""
        changed: set[int] = set()
        for _ in range(64 * len(genes)):
            if tuple(genes) not in seen:
                return genes, changed
            at = rng.randrange(len(genes))
            genes[at] = rng.randrange(len(self.values[at]))
            changed.add(at)
        new = self._first_new(seen)             # nearly used up: the first one left
        return list(new), set(range(len(genes)))

    def next_generation(self, generation: int) -> list[tuple[tuple[int, ...], tuple[int, int] | None, tuple[str, ...]]]:
        """(genes, parents, mutated) of the candidates to score next."""
        rng = random.Random(f"{self.seed}|{generation}")
        seen = {t.genes for t in self.trials}
        n = min(self.population, self.size - len(seen))
        best = self.ranked()
        chosen = []
        if self.walk or n < self.population:    # what is left fits into the budget: in order
            for _ in range(n):
                genes = self._first_new(seen)
                seen.add(genes)
                chosen.append((genes, None, ()))
            return chosen
        if not best:
            for _ in range(n):
                genes, _ = self._renew(rng, [rng.randrange(len(v)) for v in self.values], seen)
                seen.add(tuple(genes))
                chosen.append((tuple(genes), None, ()))
            return chosen
        mother, father = best[0], best[min(1, len(best) - 1)]
        while len(chosen) < n:
            swap = [rng.random() < 0.5 for _ in self.names]
            pair = [[f if s else m for m, f, s in zip(mother.genes, father.genes, swap)],
                    [m if s else f for m, f, s in zip(mother.genes, father.genes, swap)]]
            for genes in pair[:n - len(chosen)]:
                drawn = set()
                for _ in range(self.mutations):
                    if rng.random() < self.mutation_prob:
                        at = rng.randrange(len(genes))
                        genes[at] = rng.randrange(len(self.values[at]))
                        drawn.add(at)
                genes, more = self._renew(rng, genes, seen)
                seen.add(tuple(genes))
                chosen.append((tuple(genes), (mother.id, father.id), tuple(self.names[i] for i in sorted(drawn | more))))
        return chosen

    # ------------------------------------------------------------ scores

    def _score(self, folds: Folds, genes: tuple[int, ...]) -> tuple[float | None, str | None]:
        learner = self.pipeline.getStages()[-1]
        try:
            tuned = learner.copy({learner.getParam(k): v for k, v in self.params(genes).items()})
            rows = fold_metrics(folds.held_out(tuned, parallelism=self.parallelism), self.label).where(F.col("metric") == self.metric).collect()
        except (IllegalArgumentException, TypeError, ValueError) as e:
            return None, f"{type(e).__name__}: {str(e)[:200]}"
        return (float(rows[0]["mean"]), None) if rows and rows[0]["mean"] is not None else (None, "no held-out rows")

    # ------------------------------------------------------------ state

    def _rows(self, trials: list[Trial]) -> list[tuple]:
        sizes = Counter(t.generation for t in trials)
        return [(t.id, t.generation, t.trial, sizes[t.generation], dict(zip(self.names, t.genes)),
                 json.dumps(self.params(t.genes), sort_keys=True), *(t.parents or (None, None)), list(t.mutated), t.score,
                 t.error, self.settings) for t in trials]

    def _save(self, spark, trials: list[Trial]) -> None:
        """One folder a generation, replaced as a whole if it was left incomplete."""
        spark.createDataFrame(self._rows(trials), STATE).coalesce(1).write.mode("overwrite") \
            .parquet(f"{self.state}/trials/generation-{trials[0].generation:06d}")

    def _load(self, spark) -> None:
        """Take over the complete generations of the state, up to the first that is missing."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/trials")
        if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            return
        # a few rows a generation: as many as the search has scored
        rows = spark.read.schema(STATE).parquet(f"{self.state}/trials/generation-*").orderBy("id").collect()
        if any(r.settings != self.settings for r in rows):
            raise ValueError(f"{self.state} holds a search with other settings")
        for generation in itertools.count():
            mine = [r for r in rows if r.generation == generation]
            if not mine or len(mine) != mine[0].size or (self.generations is not None and generation >= self.generations):
                return
            self.trials += [Trial(r.id, r.generation, r.trial, tuple(r.genes[n] for n in self.names),
                                  None if r.parent_1 is None else (r.parent_1, r.parent_2), tuple(r.mutated), r.score, r.error)
                            for r in mine]
            self._note_best()

    def _note_best(self) -> None:
        best = self.ranked()
        self.best_per_generation.append(best[0].score if best else float("-inf"))

    # ------------------------------------------------------------ search

    def _over(self, start: float) -> bool:
        done = len(self.best_per_generation)
        late = self.time_limit_min is not None and time.monotonic() - start >= 60 * self.time_limit_min
        return done > 0 and (len(self.trials) == self.size or late or self.best_per_generation[-1] >= self.score_limit
                             or (self.generations is not None and done >= self.generations))

    def run(self, train: DataFrame) -> tuple[dict, float]:
        """The best parameters and their score; goes on from ``state`` where there is one."""
        spark, start = train.sparkSession, time.monotonic()
        self.trials, self.best_per_generation = [], []
        if self.state:
            self._load(spark)
        if not self._over(start):
            with fold_features(train, self.pipeline, self.label, self.folds, self.seed, self.key) as folds:
                folds.share(self.parallelism)
                while not self._over(start):
                    generation, first = len(self.best_per_generation), len(self.trials)
                    chosen = self.next_generation(generation)
                    results = run_all(spark, [lambda g=genes: self._score(folds, g) for genes, _, _ in chosen], self.parallelism)
                    new = [Trial(first + nth, generation, nth, genes, parents, mutated, *result)
                           for nth, ((genes, parents, mutated), result) in enumerate(zip(chosen, results))]
                    if self.state:
                        self._save(spark, new)
                    self.trials += new
                    self._note_best()
        best = self.ranked()
        if not best:
            raise RuntimeError(f"no parameter set could be scored; the first failure was {self.trials[0].error}")
        return self.params(best[0].genes), best[0].score

    def trial_log(self, spark) -> DataFrame:
        """Every candidate scored: id, generation, trial, genes (positions in the value lists), params,
        parent_1 and parent_2 (ids; null in the first generation and in walks), mutated, score, error."""
        return spark.createDataFrame(self._rows(self.trials), STATE).drop("size", "settings")


def lineage(log: DataFrame) -> DataFrame:
    """What a trial log shows of its own evolution, one row a trial: id, generation, trial, ``is_new`` (no
    earlier trial has the same genes), ``parents_best`` (its parents are the two best trials of all earlier
    generations, or it has none and no earlier trial was scored) and ``genes_explained`` (each gene is one of
    a parent's or listed in ``mutated``). The window without a partition runs over one row a generation."""
    two = F.slice(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "id")))), 1, 2)
    per_generation = log.groupBy("generation").agg(two.alias("best"))
    before = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, -1)
    best = per_generation.select("generation", F.slice(F.array_sort(F.flatten(F.collect_list("best").over(before))), 1, 2).alias("best"))
    parent = lambda n: log.select(F.col("id").alias(f"parent_{n}"), F.col("genes").alias(f"genes_{n}"))
    t = log.join(parent(1), "parent_1", "left").join(parent(2), "parent_2", "left").join(best, "generation")
    first = F.min("id").over(Window.partitionBy(F.array_sort(F.map_entries("genes"))))
    wanted = F.when(F.size("best") == 0, F.col("parent_1").isNull() & F.col("parent_2").isNull()).otherwise(
        (F.col("parent_1") == F.col("best")[0]["id"]) & (F.col("parent_2") == F.element_at("best", -1)["id"]))
    explained = F.col("parent_1").isNull() | F.forall(F.map_entries("genes"), lambda e: (
        (e["value"] == F.col("genes_1")[e["key"]]) | (e["value"] == F.col("genes_2")[e["key"]])
        | F.array_contains("mutated", e["key"])))
    return t.select("id", "generation", "trial", (first == F.col("id")).alias("is_new"),
                    F.coalesce(wanted, F.lit(False)).alias("parents_best"), F.coalesce(explained, F.lit(False)).alias("genes_explained"))
