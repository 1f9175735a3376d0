"""Feature stages, persistence and exploration properties."""

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from cardsight.operators import explore, features


def test_pairwise_names_and_values(spark):
    assert features.pairwise_names(["a", "b", "c"]) == ["a*b", "a*c", "b*c", "a+b", "a+c", "b+c",
                                                         "a-b", "a-c", "b-c"]
    big = 3_000_000_000  # int product would overflow 32 and 64 bits under ANSI? cast to double first
    df = spark.createDataFrame([(big, big, 2)], "a long, b long, c int")
    r = features.PairwiseTransformer(inputCols=["a", "b", "c"]).transform(df).first()
    assert r["a*b"] == pytest.approx(9e18) and r["b-c"] == big - 2 and r["a+c"] == big + 2


def test_log_transformer_length_check(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        features.LogTransformer(inputCols=["x"], outputCols=["a", "b"]).transform(df)


def test_custom_stages_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 5.0), (3.0, -1.0)], "a double, b double")
    pipe = Pipeline(stages=[features.LogTransformer(inputCols=["a", "b"]),
                            features.PairwiseTransformer(inputCols=["a", "b"]),
                            features.BoxCoxTransformer(inputCol="b", outputCol="bc", alpha=0.5)])
    m = pipe.fit(df)
    path = str(tmp_path / "p")
    m.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert loaded.transform(df).collect() == m.transform(df).collect()
    assert loaded.stages[2].getAlpha() == 0.5


def test_unseen_category_is_all_zeros(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "c string, x double")
    test = spark.createDataFrame([("z", 1.0), (None, 1.0), ("b", 1.0)], "c string, x double")
    stages = features.feature_stages(["c"], ["x"], use_pairwise=False)[:2]
    m = Pipeline(stages=stages).fit(train)
    out = features.ohe_slots(m.transform(test.withColumn("k", F.monotonically_increasing_id())),
                             {"c": "c_ohe"}, "k").orderBy("k").collect()
    assert [r.slot for r in out] == [None, None, 1]


def test_one_hot_slots_without_metadata_match(spark):
    # metadata path (index + encoder width) and dense fallback agree, including unseen and NULL
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T
    train = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("c", 1.0)], "c string, x double")
    test = spark.createDataFrame([("z", 1.0), (None, 1.0), ("b", 1.0), ("a", 1.0), ("c", 1.0)],
                                 "c string, x double").withColumn("k", F.monotonically_increasing_id())
    m = Pipeline(stages=features.feature_stages(["c"], ["x"], use_pairwise=False)).fit(train)
    out = m.transform(test).cache()
    fast = features.ohe_slots(out, {"c": "c_ohe"}, "k").orderBy("k").collect()
    plain = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", VectorUDT()),
                          T.StructField("f", VectorUDT())])
    bare = spark.createDataFrame(out.select("k", "c_ohe", features.FEATURES).rdd, plain)
    assert "ml_attr" not in bare.schema["v"].metadata
    slow = features.ohe_slots(bare, {"c": "v"}, "k").orderBy("k").collect()
    assert [r.slot for r in fast] == [r.slot for r in slow] == [None, None, 1, 0, 2]
    assert features.vector_width(out).collect() == features.vector_width(bare, "f").collect()


def test_assembler_audit_counts_what_skip_drops(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("b", 0.0, 3), (None, float("nan"), 1), ("a", 2.0, None), ("a", 3.0, 4)],
                               "c string, x double, n int")
    stages = features.feature_stages(["c"], ["x", "n"], use_pairwise=True)
    audit = {r.column: r.n_invalid for r in features.assembler_audit(df, stages).collect()}
    kept = Pipeline(stages=stages).fit(df).transform(df).count()
    assert audit["__rows__"] - audit["__any__"] == kept == 2
    assert audit["x"] == 1 and audit["ln_x"] == 2 and audit["n"] == 1
    assert not any(c.endswith("_ohe") for c in audit)        # one-hot vectors are never invalid


def test_histogram_auto_without_classes(spark):
    import numpy as np
    vs = [float(v) for v in range(0, 300, 7)] + [1000.0]
    df = spark.createDataFrame([(v,) for v in vs], "x double")
    h = explore.histogram(df, ["x"], bins="auto").collect()
    assert len(h) == len(np.histogram(vs, bins="auto")[0])
    assert sum(r["count"] for r in h) == len(vs) and all(r["class"] is None for r in h)


def test_invalid_rows_counts(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, None), (0.0, 3)], "a double, b int")
    df = features.LogTransformer(inputCols=["a"]).transform(df)
    got = {r.column: r.n_invalid for r in features.invalid_rows(df, ["a", "b", "ln_a"]).collect()}
    assert got == {"a": 2, "b": 1, "ln_a": 3, "__any__": 3, "__rows__": 4}


def test_assembler_skip_drops_invalid(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("a", 2.0)], "c string, x double")
    m = Pipeline(stages=features.feature_stages(["c"], ["x"])).fit(df)
    assert m.transform(df).count() == 2          # ln(0) is NULL -> row skipped


def test_histogram_counts_sum_and_constant_column(spark):
    df = spark.createDataFrame([(float(i), 5.0, i % 2) for i in range(101)], "x double, k double, y int")
    h = explore.histogram(df, ["x", "k"], by="y", bins=7).collect()
    assert sum(r["count"] for r in h if r.column == "x") == 101
    k = [r for r in h if r.column == "k" and r["count"] > 0]
    assert all(r.lo <= 5.0 <= r.hi for r in k)


def test_histogram_auto_bins_match_numpy(spark):
    import random
    import numpy as np
    rng = random.Random(3)
    vals = {0: [round(rng.lognormvariate(3, 1), 2) for _ in range(700)] + [50.0] * 300,   # hot value
            1: [float(rng.randint(0, 9)) for _ in range(40)]}
    df = spark.createDataFrame([(v, k) for k, vs in vals.items() for v in vs], "x double, y int")
    h = explore.histogram(df, ["x"], by="y", bins="auto").collect()
    for k, vs in vals.items():
        rows = sorted((r.bin, r["count"]) for r in h if r["class"] == str(k))
        counts, edges = np.histogram(vs, bins="auto")
        assert len(rows) == len(counts)
        assert sum(c for _, c in rows) == len(vs)


def test_kde_integrates_to_one(spark):
    import random
    rng = random.Random(0)
    df = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(500)], "x double")
    pts = sorted((r.x, r.density) for r in explore.kde(df, ["x"]).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert area == pytest.approx(1.0, abs=2e-3)
    binned = sorted((r.x, r.density) for r in explore.kde(df, ["x"], bins=256).collect())
    assert max(abs(a[1] - b[1]) for a, b in zip(pts, binned)) < 1e-3


def test_box_stats_match_python(spark):
    vals = [1, 2, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = explore.box_stats(df, ["x"]).first()

    def pct(p):
        h = (len(vals) - 1) * p
        lo = math.floor(h)
        return vals[lo] + (h - lo) * (vals[min(lo + 1, len(vals) - 1)] - vals[lo])
    assert (r.q1, r.median, r.q3) == pytest.approx((pct(.25), pct(.5), pct(.75)))
    assert r.whisker_hi == 8.0 and r.n_outliers == 1 and r.whisker_lo == 1.0
    approx = explore.box_stats(df, ["x"], approx=True).first()
    assert approx.n == 10 and approx.n_outliers == 1


def test_crosstab_pairs_counts(spark):
    df = spark.createDataFrame([("a", "x", "p"), ("a", "y", "p"), ("b", "x", None)], "c1 string, c2 string, c3 string")
    out = explore.crosstab_pairs(df, ["c1", "c2", "c3"]).collect()
    assert sum(r["count"] for r in out) == 9       # 3 pairs x 3 rows
    wide = explore.crosstab_wide(df, "c1", "c2", ["x", "y"]).orderBy("c1").collect()
    assert [(r.c1, r.x, r.y) for r in wide] == [("a", 1, 1), ("b", 1, 0)]


def test_score_models_single_pass_equals_separate(spark):
    from cardsight.operators import models as M
    import random
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.random() * 10, int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, c string, x double, y int")
    fitted = M.fit_models(df, features.feature_stages(["c"], ["x"]),
                          {"gbt": M.gbt("y", maxIter=3, maxDepth=2), "lr": M.logistic("y", maxIter=5)})
    together = M.score_models(fitted, df, "y", keep=["id"])
    separate = M.score(fitted["gbt"], df, "y", keep=["id"], name="gbt").unionByName(
        M.score(fitted["lr"], df, "y", keep=["id"], name="lr"))
    assert sorted(together.collect()) == sorted(separate.collect())
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 1


def test_log_transformer_output_names_and_odd_columns(spark):
    df = spark.createDataFrame([(math.e, 1.0)], "`a.b` double, `it's` double")
    out = features.LogTransformer(inputCols=["a.b", "it's"], outputCols=["x", "y"]).transform(df).first()
    assert (out.x, out.y) == (pytest.approx(1.0), 0.0)
    with pytest.raises(ValueError, match="2 inputs but 1"):
        features.LogTransformer(inputCols=["a.b", "it's"], outputCols=["x"]).transform(df)


def test_vector_slots_read_the_vectors(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense([1.0, 0.0]),), (Vectors.sparse(2, [1], [3.0]),)], ["v"])
    assert [tuple(r) for r in features.vector_slots(df, "v").orderBy("slot").collect()] == [(0, 2, 1, 0.5), (1, 2, 1, 1.5)]
