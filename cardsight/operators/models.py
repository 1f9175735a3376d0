"""Learners, scoring and feature importances.

Training and scoring are Spark ML jobs; the driver only holds model objects and the
feature-name list of the assembler (model metadata, one entry per vector slot).
"""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from ..session import cached, scratch_table
from .features import FEATURES, vector_size

# The reference's tuned boosted-trees settings.
TUNED_GBT = {"maxDepth": 10, "maxIter": 50, "stepSize": 0.05, "subsamplingRate": 0.7,
             "minInstancesPerNode": 5, "minInfoGain": 0.01, "maxBins": 32}

# Trees read a row as one int a slot: a training partition holds about 32 MB of them, however many rows there are.
SLOT_BYTES, PART_BYTES = 4, 32 << 20


def gbt(label: str, features: str = FEATURES, seed: int = 0, **params) -> GBTClassifier:
    """Binary gradient-boosted trees (H1)."""
    return GBTClassifier(featuresCol=features, labelCol=label, seed=seed, **params)


def random_forest(label: str, features: str = FEATURES, seed: int = 0, **params) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed, **params)


def logistic(label: str, features: str = FEATURES, **params) -> LogisticRegression:
    return LogisticRegression(featuresCol=features, labelCol=label, **params)


def parts_for(rows: int, width: int) -> int:
    """Partitions of ``PART_BYTES`` each for vectors of ``width`` slots."""
    return max(1, -(-rows * width * SLOT_BYTES // PART_BYTES))


def in_even_parts(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` of ``rows`` rows dealt evenly over :func:`parts_for` partitions.

    Their number follows the rows and not the files, whose splits may be few or uneven. Rows are dealt round robin,
    however often a value repeats."""
    return df.repartition(parts_for(rows, width))


def training_rows(feat: PipelineModel, df: DataFrame, columns: list[str], features: str, rows: int | None = None) -> DataFrame:
    """``columns`` of ``df`` after the fitted feature stages, in even partitions: a learner reads them once a pass.

    The rows are dealt out before their vectors are made, and ordered by their hash, because learners draw
    subsamples by a row's place in its partition."""
    even = in_even_parts(df, df.count() if rows is None else rows, vector_size(feat.transform(df), features))
    hashed = [F.col(quoted(f.name)) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return feat.transform(even.sortWithinPartitions(F.xxhash64(*hashed))).select(*columns)


def fit_pipeline(train: DataFrame, stages: list) -> PipelineModel:
    """Ordered stages, fit then return the fitted pipeline.

    When the last stage is an estimator (a learner making several passes), the
    featurised training set is persisted once for it instead of being recomputed from
    the source on every pass.
    """
    if stages and isinstance(stages[-1], Estimator):
        return fit_models(train, stages[:-1], {"_": stages[-1]})["_"]
    return Pipeline(stages=stages).fit(train)


def fit_models(train: DataFrame, feature_stages: list, estimators: dict) -> dict[str, PipelineModel]:
    """Several learners on the same features (H3): the feature stages are fitted and
    applied once, the featurised training set is persisted and shared by every learner."""
    feat = Pipeline(stages=feature_stages).fit(train)
    used = {est.getOrDefault(p) for est in estimators.values() for p in (est.labelCol, est.featuresCol)}
    vector = next(iter(estimators.values())).getOrDefault("featuresCol")
    with cached(training_rows(feat, train, sorted(used), vector)) as feats:   # not the columns the vector repeats
        return {name: PipelineModel(stages=list(feat.stages) + [est.fit(feats)])
                for name, est in estimators.items()}


def positive_probability(col: str = "probability") -> F.Column:
    """Class-1 probability from the probability vector, JVM-side."""
    return vector_to_array(F.col(col))[1]


def score(model: PipelineModel, df: DataFrame, label: str, keep: list[str] | None = None,
          name: str | None = None) -> DataFrame:
    """Batch scoring (H4): (keep..., [model], label, prediction, p1)."""
    out = model.transform(df)
    cols = [F.col(c) for c in (keep or [])]
    if name is not None:
        cols.append(F.lit(name).alias("model"))
    return out.select(*cols, F.col(label), F.col("prediction"), positive_probability().alias("p1"))


def _shared_prefix(models: dict[str, PipelineModel]) -> list | None:
    """The fitted feature stages, if every pipeline reuses the very same stage objects."""
    pipes = list(models.values())
    prefix = pipes[0].stages[:-1]
    for p in pipes[1:]:
        if len(p.stages) != len(prefix) + 1 or any(a is not b for a, b in zip(p.stages[:-1], prefix)):
            return None
    return prefix


def score_models(models: dict[str, PipelineModel], df: DataFrame, label: str,
                 keep: list[str] | None = None) -> DataFrame:
    """All models' predictions stacked with a ``model`` column, for grouped evaluation.

    When the pipelines share their fitted feature stages (as :func:`fit_models` builds
    them), the input is scanned and featurised once and every classifier is applied to
    the same rows with its own output columns; one ``explode`` then yields the long
    form. Otherwise each pipeline scores separately and the results are unioned.
    """
    keep = keep or []
    prefix = _shared_prefix(models) if len(models) > 1 else None
    if prefix is None:
        frames = [score(m, df, label, keep, name) for name, m in models.items()]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
    out = PipelineModel(stages=list(prefix)).transform(df)
    cells = []
    for i, (name, pm) in enumerate(models.items()):
        clf = pm.stages[-1]
        clf = clf.copy({clf.predictionCol: f"_pred{i}", clf.probabilityCol: f"_prob{i}",
                        clf.rawPredictionCol: f"_raw{i}"})
        out = clf.transform(out)
        cells.append(F.struct(F.lit(name).alias("model"), F.col(f"_pred{i}").alias("prediction"),
                              positive_probability(f"_prob{i}").alias("p1")))
    long = out.select(*[F.col(c) for c in keep], F.col(label), F.explode(F.array(*cells)).alias("_m"))
    return long.select(*keep, F.col("_m.model").alias("model"), label, F.col("_m.prediction").alias("prediction"),
                       F.col("_m.p1").alias("p1"))


def scored_once(models: dict[str, PipelineModel], df: DataFrame, label: str) -> DataFrame:
    """:func:`score_models` for several evaluations: rows dealt out evenly, each scored once, predictions stored."""
    first = next(iter(models.values()))
    width = vector_size(PipelineModel(first.stages[:-1]).transform(df), first.stages[-1].getFeaturesCol())
    return scratch_table(score_models(models, in_even_parts(df, df.count(), width), label), "scored")


def score_side_by_side(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """Class-1 probability of every model in a column of its name, for the same rows in one scan."""
    out = df
    for i, (name, model) in enumerate(models.items()):
        before = set(out.columns)
        out = model.transform(out).withColumn(f"_p{i}", positive_probability())
        out = out.drop(*[c for c in out.columns if c not in before and c != f"_p{i}"])
    return out.select(*[F.col(f"_p{i}").alias(name) for i, name in enumerate(models)])


def slot_names(transformed: DataFrame, features: str = FEATURES) -> list[str]:
    """Assembler slot names from the vector column's ML attribute metadata."""
    attrs = transformed.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    slots = {}
    for group in attrs.values():
        for a in group:
            slots[a["idx"]] = a["name"]
    return [slots[i] for i in sorted(slots)]


def feature_importance(model: PipelineModel, sample: DataFrame, fold_one_hot: bool = False,
                       features: str = FEATURES) -> DataFrame:
    """(feature, importance), most important first (H5).

    Names come from the assembler's metadata (schema of ``sample`` transformed, no job
    runs). ``fold_one_hot`` sums the one-hot slots of each categorical column into one
    row named after the column.
    """
    names = slot_names(model.transform(sample.limit(0)), features)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = []
    for i, name in enumerate(names):
        src = name.split("_ohe_")[0] if (fold_one_hot and "_ohe_" in name) else name
        rows.append((src, float(imp[i]) if i < len(imp) else 0.0))
    df = sample.sparkSession.createDataFrame(rows, "feature string, importance double")
    if fold_one_hot:
        df = df.groupBy("feature").agg(F.sum("importance").alias("importance"))
    return df.orderBy(F.desc("importance"), F.asc("feature"))
