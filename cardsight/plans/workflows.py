"""End-to-end flows: preparation, modelling and threshold tuning as Spark plans.

Each flow is a short composition of the operators; data stays in Spark throughout and
results come back as DataFrames. Outputs are written with ``partitionBy('portion')`` so
the modelling and tuning flows read only the portion they need.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, features, models, prepare, sampling, threshold, tune
from ..sources import files, schemas
from ..sources.models import load_model, save_model


def preparation_flow(spark: SparkSession, train_csv: str, test_csv: str, out_path: str, as_of=None,
                     fmt: str = "parquet", mode: str = "errorifexists", key: str = "trans_num") -> DataFrame:
    """Raw train/test CSVs -> tagged union -> prepared table, written once.

    The transaction number is kept (as ``txn_id``) as the stable row key that
    reproducible sampling and folds hash; the other identifying columns are dropped.
    Returns the prepared DataFrame (lazy) after writing it to ``out_path``.
    """
    train = files.read_raw_transactions(spark, train_csv)
    test = files.read_raw_transactions(spark, test_csv)
    drop = [c for c in schemas.IDENTIFYING_COLUMNS if c != key]
    prepared = (prepare.prepare(prepare.tag_union({"train": train, "test": test}), as_of=as_of, drop=drop)
                .withColumnRenamed(key, "txn_id"))
    if fmt == "csv":
        files.write_csv(prepared, out_path, mode=mode, partition_by=["portion"])
    else:
        files.write_parquet(prepared, out_path, mode=mode, partition_by=["portion"])
    return prepared


def read_prepared(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return files.read_csv(spark, path, infer=True, timestamp_format=files.CSV_TIMESTAMP_FORMAT)
    return spark.read.parquet(path)


def modelling_flow(prepared: DataFrame, label: str = schemas.LABEL, key: str = "txn_id",
                   estimators: dict | None = None, fractions: dict | None = None, seed: int = 123,
                   use_pairwise: bool = True, model_path: str | None = None, on_invalid: str = "skip") -> dict:
    """Split -> stratified down-sample -> shared feature stages -> several learners ->
    grouped evaluation on the test portion; optionally save the first model.

    Returns {'models': {name: PipelineModel}, 'report': DataFrame, 'auc': DataFrame,
    'distribution': DataFrame, 'dropped': DataFrame}. ``dropped`` (portion, column,
    n_invalid) counts the rows the assembler's ``skip`` removes from the training sample
    and from the evaluated test portion, per input column and in total.
    """
    train, test = prepare.split_portions(prepared)
    sample = sampling.stratified_sample(train, label, fractions or {0: 0.10, 1: 1.0}, seed, key=key)
    model_cols = prepare.model_input(sample, extra_drop=[key])
    cat, num = files.feature_roles(model_cols, label)
    stages = features.feature_stages(cat, num, use_pairwise=use_pairwise, on_invalid=on_invalid)
    estimators = estimators or {"GBTClassifier": models.gbt(label)}
    fitted = models.fit_models(sample, stages, estimators)
    preds = models.score_models(fitted, test, label)
    out = {
        "models": fitted,
        "report": evaluate.classification_report(preds, label, "prediction", by=["model"]),
        "auc": evaluate.roc_auc(preds, label, "p1", by=["model"]),
        "distribution": sample.groupBy(label).count(),
        "dropped": features.assembler_audit(sample, stages).withColumn("portion", F.lit("train"))
                   .unionByName(features.assembler_audit(test, stages).withColumn("portion", F.lit("test")))
                   .select("portion", "column", "n_invalid"),
    }
    if model_path:
        save_model(next(iter(fitted.values())), model_path)
    return out


def search_flow(prepared: DataFrame, pipeline: Pipeline, ranges: dict, label: str = schemas.LABEL,
                key: str = "txn_id", **search_kw) -> tuple[dict, float, DataFrame]:
    """Evolutionary search on the down-sampled training portion; returns
    (best parameters, best score, trial log)."""
    train, _ = prepare.split_portions(prepared)
    sample = sampling.stratified_sample(train, label, {0: 0.10, 1: 1.0}, 123, key=key)
    search = tune.EvolutionarySearch(pipeline, ranges, label, key=key, **search_kw)
    best, score = search.run(sample)
    return best, score, search.trial_log(prepared.sparkSession)


def threshold_flow(prepared: DataFrame, model_path: str, label: str = schemas.LABEL, key: str = "txn_id",
                   objective: str = "precision", test_threshold: float | None = 0.6) -> dict:
    """Load a fitted pipeline, score the training sample once, sweep 36 cut-offs in one
    aggregate, pick the best, and report the test portion at ``test_threshold`` (or at
    the chosen cut-off when None)."""
    model = load_model(model_path)
    train, test = prepare.split_portions(prepared)
    sample = sampling.stratified_sample(train, label, {0: 0.10, 1: 1.0}, 123, key=key)
    scored = models.score(model, sample, label)
    sweep = threshold.threshold_sweep(scored, label, "p1")
    best = threshold.best_threshold(sweep, objective)
    t = test_threshold if test_threshold is not None else best.first()["threshold"]
    test_scored = models.score(model, test, label)
    return {"sweep": sweep, "best": best,
            "test_report": threshold.score_at_threshold(test_scored, label, "p1", t)}
