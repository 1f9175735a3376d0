"""Hand-made edge frames: all-NULL column, one row, one class only, NaN."""

import pytest
from pyspark.sql import functions as F

from cardsight.operators import distribution, evaluate, explore, features, threshold


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, None, float("nan") if i % 5 == 0 else float(i), 0) for i in range(50)]
    return spark.createDataFrame(rows, "id long, empty double, x double, y int")


def test_all_null_column_is_absent_not_an_error(spark, odd):
    h = explore.histogram(odd, ["empty", "x"], bins=5).collect()
    assert {r.column for r in h} == {"x"} and sum(r["count"] for r in h) == 40   # NaN excluded
    assert {r.column for r in explore.kde(odd, ["empty", "x"], grid_size=20).collect()} == {"x"}
    assert {r.column for r in explore.box_stats(odd, ["empty", "x"]).collect()} == {"x"}
    assert distribution.value_counts(odd, ["empty"]).count() == 0
    inv = {r.column: r.n_invalid for r in features.invalid_rows(odd, ["empty", "x"]).collect()}
    assert inv == {"empty": 50, "x": 10, "__any__": 50, "__rows__": 50}


def test_one_row(spark):
    one = spark.createDataFrame([(1, 0.7, 3.0)], "y int, s double, x double")
    r = explore.box_stats(one, ["x"]).first()
    assert (r.n, r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi, r.n_outliers) == (1, 3.0, 3.0, 3.0, 3.0, 3.0, 0)
    assert explore.kde(one, ["x"]).count() == 0            # no spread: no bandwidth
    h = explore.histogram(one, ["x"], bins=4).collect()
    assert sum(r["count"] for r in h) == 1 and min(r.lo for r in h) == 2.5 and max(r.hi for r in h) == 3.5
    assert evaluate.roc_auc(one, "y", "s").first().auc is None


def test_one_class_only(spark):
    df = spark.createDataFrame([(0, i / 10.0) for i in range(10)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first().auc is None
    pred = df.withColumn("p", (F.col("s") > 0.5).cast("double"))
    assert evaluate.balanced_accuracy(pred, "y", "p").first().balanced_accuracy is None
    sweep = threshold.threshold_sweep(df, "y", "s").collect()
    assert all(r.tp == 0 and r.fn == 0 for r in sweep)
    # one label class: weighted precision is class 0's precision (always 1 when predicted)
    assert all(r.weighted_precision in (0.0, 1.0) for r in sweep)
    m = {r.metric: r.value for r in evaluate.multi_metrics(pred, "y", "p").collect()}
    assert m["accuracy"] == pytest.approx(0.6) and m["recallByLabel"] == pytest.approx(0.6)


def test_nan_scores_rank_highest(spark):
    # Spark orders NaN above every number, so a NaN score is predicted positive everywhere
    df = spark.createDataFrame([(1, float("nan")), (0, 0.2), (1, 0.9)], "y int, s double")
    sweep = {r.threshold_index: r for r in threshold.threshold_sweep(df, "y", "s").collect()}
    direct = df.where(F.col("s") > 0.1 + 0.025 * 35).count()
    assert sweep[35].tp + sweep[35].fp == direct


def test_shared_dir_needs_a_shared_folder_on_clusters():
    # stub session: no spark.checkpoint.dir, no checkpoint dir on the context
    from types import SimpleNamespace

    from cardsight import session

    class Opt:
        def isDefined(self):
            return False

    def stub(master):
        sc = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d=None: d),
                             _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: Opt())),
                             setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=sc)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(stub("yarn"))
    assert session.shared_dir(stub("local[2]"))          # tests get a private folder


def test_null_keys_stay_in_samples_and_folds(spark):
    from cardsight.operators import sampling
    df = spark.createDataFrame([(1, 0), (None, 0), (None, 1)], "k long, y int")
    assert sampling.stratified_sample(df, "y", {0: 1.0, 1: 1.0}, 5, key="k").count() == 3
    assert sampling.assign_folds(df, 3, 5, "k").where("fold is null").count() == 0


def test_ordinary_csv_timestamps_are_read(spark, tmp_path):
    from cardsight.sources import files
    p = tmp_path / "in.csv"
    p.write_text("t,n\n2019-01-01 00:00:18,1\nnot a time,x\n")
    typed = files.read_csv(spark, str(p), schema=spark.createDataFrame([], "t timestamp, n int").schema)
    assert typed.where("t is not null").count() == 1
    lost = {r.column: r["count"] for r in files.unparsed(spark, str(p), typed.schema).collect()}
    assert lost == {"t": 1, "n": 1}
    clean = tmp_path / "clean.csv"
    clean.write_text("t\n2019-01-01 00:00:18\n")
    assert dict(files.read_csv(spark, str(clean), infer=True).dtypes) == {"t": "timestamp"}


def test_nan_scores_rank_highest_on_a_grid_too(spark):
    from cardsight.operators import evaluate
    rows = [(1, float("nan")), (1, 0.8), (0, 0.3), (0, 0.2), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first().auc == evaluate.roc_auc(df, "y", "s", bins=10).first().auc == 1.0


def test_heavy_tail_and_infinite_values(spark):
    from cardsight.operators import explore
    df = spark.range(20000).selectExpr("cast(id % 100 as double) as x").unionAll(spark.createDataFrame([(1e7,)], "x double"))
    auto = explore.histogram(df, ["x"], bins="auto")
    got = auto.selectExpr("count(*) as bins", "sum(count) as n", "max(bin) as last").first()
    assert got.n == 20001 and got.last == got.bins - 1 > 50_000
    odd = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, float("inf")), (float("inf"), 4.0)], "x double, y double")
    h = explore.histogram(odd, ["x"], bins=2).orderBy("bin").collect()
    assert [(r.lo, r.hi, r["count"]) for r in h] == [(1.0, 2.0, 1), (2.0, 3.0, 2)]
    assert sorted((r.bin_x, r.bin_y) for r in explore.scatter_bins(odd, ["x", "y"], bins=2).collect()) == [(0, 0), (1, 0)]
    assert {r.column: r.n_infinite for r in explore.nonfinite_counts(odd, ["x", "y"]).collect()} == {"x": 1, "y": 1}
