"""Plan guards for every registered query that needs no model fit: no cartesian or
nested-loop joins, no Python evaluation in the plan, scans of ``events`` read only
the columns the query uses (never the unused ``props`` column), and nothing but
bounded tables passes through a single-partition exchange."""

import re

import pytest

import __spark_entry__ as E

from cardsight.plans import q_models, registry

from conftest import SF_SMALL

registry.load_all()
# Queries that fit or score a model, and those that are answered while they are built (bounded results).
MODEL_QUERIES = {n for n, fn in registry.QUERIES.items() if fn.__module__ == q_models.__name__ and n != "model_roc_curve"}
PLANNED = sorted(set(registry.QUERIES) - MODEL_QUERIES)
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]


def plan_text(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + "\n" + qe.optimizedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_plan_guards(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    text = plan_text(df)
    for node in FORBIDDEN:
        assert node not in text, f"{name}: {node}"
    physical = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in physical.splitlines() if "FileScan" in line or "ReadSchema" in line]
    assert not any("props" in line for line in scans), f"{name} reads the unused props column"


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = E.queries()["threshold_sweep"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in text


# What may feed an ``Exchange SinglePartition`` (one task): partial aggregates (one row
# per map task) anywhere, and these tables whose size parameters bound.
BOUNDED_SINGLE = [
    (re.compile(r"HashAggregate\(keys=\[_range\]"), "per-range totals: one row a range"),
    (re.compile(r"Project \[k, coalesce\(pos"), "cut-off grid: 37 rows"),
    (re.compile(r"Project \[class, support"), "per-class report rows: one per label value"),
]


def unbounded_single_partition_inputs(df) -> list[str]:
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        child = re.sub(r"#\d+", "", lines[i + 1]) if i + 1 < len(lines) else ""
        if not ("partial_" in child or any(p.search(child) for p, _ in BOUNDED_SINGLE)):
            bad.append(child.strip()[:160])
    return bad


@pytest.mark.parametrize("name", PLANNED)
def test_single_partition_exchanges_carry_bounded_tables(spark, name):
    bad = unbounded_single_partition_inputs(E.queries()[name](spark, SF_SMALL))
    assert not bad, f"{name}: unbounded input to a single-partition exchange: {bad}"


def test_single_partition_guard_catches_a_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    rows = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "value")
    funnel = rows.withColumn("cum", F.sum("value").over(Window.orderBy("event_id")))
    assert unbounded_single_partition_inputs(funnel)
    assert not unbounded_single_partition_inputs(rows.agg(F.sum("value")))


# ------------------------------------------------------------- ranks by range exchange

def count_jobs(spark, work) -> int:
    before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    work()
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before


@pytest.mark.parametrize("name", ["roc_curve", "roc_auc", "model_roc"])
def test_ranks_run_nothing_while_planned_and_hold_no_split_points(spark, name):
    fn = E.queries()[name]
    schema_jobs = count_jobs(spark, lambda: spark.read.parquet(f"{SF_SMALL}/events.parquet").schema)
    frames = []
    assert count_jobs(spark, lambda: frames.append(fn(spark, SF_SMALL))) <= schema_jobs
    text = frames[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in text and max(map(len, re.findall(r"\[[0-9., E-]+\]", text)), default=0) < 200


def final_plan(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_ranked_rows_go_through_one_exchange_after_the_group_by(spark):
    from pyspark.sql import functions as F

    from cardsight.operators import ordered
    rows = spark.range(2000).select((F.col("id") % 500).alias("k"), F.lit(1).cast("long").alias("v"))
    df = rows.groupBy("k").agg(F.sum("v").alias("v"))
    text = final_plan(ordered.running_totals(df, "k", ["v"], ranges=5))
    own = "\n".join(line for line in text.split("Subqueries")[0].splitlines() if "ReusedExchange" not in line)
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)", own)
    # the group-by's, the one for the rows, and one for the sums of each range
    assert sorted(re.sub(r"#.*", "", e) for e in exchanges).count("_range") <= 2 and len(exchanges) <= 3
    assert text.count("Range (0, 2000") == 1         # the input is read once: all uses read the group-by's exchange
