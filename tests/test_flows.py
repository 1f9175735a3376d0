"""End-to-end flows and streaming scoring on the driver's sf0.001 events."""

import os

from pyspark.sql import functions as F

from cardsight.operators import models
from cardsight.plans import workflows
from cardsight.plans.q_prepare import raw_from_events
from cardsight.sources import files
from cardsight.sources.tables import table
from cardsight.streaming import scoring

from conftest import SF_SMALL


def test_prepare_model_threshold_stream(spark, tmp_path):
    raw = raw_from_events(table(spark, SF_SMALL, "events"))
    train_csv, test_csv = str(tmp_path / "train"), str(tmp_path / "test")
    files.write_csv(raw.where("portion = 'train'").drop("portion"), train_csv)
    files.write_csv(raw.where("portion = 'test'").drop("portion"), test_csv)

    out = str(tmp_path / "prepared")
    workflows.preparation_flow(spark, train_csv, test_csv, out, as_of="2024-02-01")
    prepared = workflows.read_prepared(spark, out)
    assert prepared.count() == raw.count()
    assert {"age", "distance_km", "trans_hour", "portion", "txn_id"} <= set(prepared.columns)
    assert "dob" not in prepared.columns and "cc_num" not in prepared.columns
    # the portion predicate prunes partitions
    plan = prepared.where("portion = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "portion" in plan

    model_path = str(tmp_path / "model")
    res = workflows.modelling_flow(prepared, estimators={"GBTClassifier": models.gbt("is_fraud", maxIter=3,
                                                                                      maxDepth=3)},
                                   model_path=model_path)
    rep = {r.row: r for r in res["report"].collect()}
    # trained on a 10%-of-negatives sample, so the cut-off 0.5 over-flags; ranking is what to check
    assert set(rep) == {"0.0", "1.0", "accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"].f1_score > 0.5
    assert res["auc"].first().auc > 0.9

    th = workflows.threshold_flow(prepared, model_path)
    assert th["sweep"].count() == 36 and th["best"].count() == 1
    assert th["test_report"].where("row = 'accuracy'").count() == 1

    # stream the test portion through the saved model
    model = models.PipelineModel.load(model_path)
    test_dir = os.path.join(out, "portion=test")
    stream = scoring.read_stream(spark, test_dir, prepared.drop("portion").schema)
    q = scoring.write_stream(scoring.score_stream(model, stream, 0.6, keep=["txn_id", "is_fraud"]),
                             str(tmp_path / "scored"), checkpoint=str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    scored = spark.read.parquet(str(tmp_path / "scored"))
    batch = models.score(model, prepared.where("portion = 'test'"), "is_fraud", keep=["txn_id"])
    assert scored.count() == batch.count()
    # the audit accounts for exactly the test rows the assembler skipped
    d = {(r.portion, r.column): r.n_invalid for r in res["dropped"].collect()}
    assert d[("test", "__rows__")] - d[("test", "__any__")] == batch.count()
    assert d[("test", "__rows__")] == prepared.where("portion = 'test'").count()
    assert d[("test", "ln_trans_hour")] > 0          # hour 0 has no log
    b = batch.select("txn_id", F.col("p1").alias("p1_batch"))
    diff = scored.join(b, "txn_id").where(F.abs(F.col("p1") - F.col("p1_batch")) > 1e-12).count()
    assert diff == 0


def test_preparation_flow_csv_partitioned(spark, tmp_path):
    raw = raw_from_events(table(spark, SF_SMALL, "events"))
    tr, te = str(tmp_path / "tr"), str(tmp_path / "te")
    files.write_csv(raw.where("portion = 'train'").drop("portion"), tr)
    files.write_csv(raw.where("portion = 'test'").drop("portion"), te)
    out = str(tmp_path / "prep_csv")
    workflows.preparation_flow(spark, tr, te, out, as_of="2024-02-01", fmt="csv")
    assert {"portion=test", "portion=train"} <= set(os.listdir(out))
    back = workflows.read_prepared(spark, out, fmt="csv")
    assert back.count() == raw.count()
    assert dict(back.dtypes)["age"] == "int" and dict(back.dtypes)["distance_km"] == "double"
