"""Preparation, scalar expressions and sampling on hand-made edge frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cardsight.functions import scalar
from cardsight.operators import distribution, prepare, sampling
from cardsight.sources import files, schemas


def test_haversine_identical_and_antipodal(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 180.0, 0.0), (10.0, 20.0, 10.0, 20.0), (None, 1.0, 2.0, 3.0)],
        "lon1 double, lat1 double, lon2 double, lat2 double")
    out = [r[0] for r in df.select(scalar.haversine_km("lon1", "lat1", "lon2", "lat2")).collect()]
    assert out[0] == 0.0 and out[2] == 0.0
    assert out[1] == pytest.approx(math.pi * 6371.0, rel=1e-12)
    assert out[3] is None


def test_haversine_matches_python_formula(spark):
    pts = [(-122.4, 37.7, -73.9, 40.7), (2.35, 48.85, 151.2, -33.8)]
    df = spark.createDataFrame(pts, "lon1 double, lat1 double, lon2 double, lat2 double")
    got = [r[0] for r in df.select(scalar.haversine_km("lon1", "lat1", "lon2", "lat2")).collect()]
    for (lo1, la1, lo2, la2), g in zip(pts, got):
        lo1, la1, lo2, la2 = map(math.radians, (lo1, la1, lo2, la2))
        a = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        assert g == pytest.approx(6371.0 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)), rel=1e-12)


def test_age_leap_day_and_malformed(spark):
    df = spark.createDataFrame([("2000-02-29",), ("not a date",), (None,)], "dob string")
    out = df.select(scalar.age_years(scalar.as_date("dob"), "2024-02-28").alias("a")).collect()
    # 8765 days / 365 = 24.01 -> 24 (leap days ignored, as the days/365 rule does)
    assert out[0].a == 24
    assert out[1].a is None and out[2].a is None


def test_calendar_parts_sunday_is_one(spark):
    df = spark.createDataFrame([("2024-03-03 13:45:00",)], "t string")  # a Sunday
    ts = scalar.parse_timestamp("t")
    r = df.select(*[c.alias(n) for n, c in scalar.calendar_parts(ts).items()]).first()
    assert (r.trans_month, r.trans_hour, r.trans_day_of_week, r.trans_day_of_month, r.trans_day_of_year) == \
        (3, 13, 1, 3, 63)


def test_prepare_raw_schema(spark):
    row = (1, "2019-01-01 00:00:18", 2703186189652095, "m1", "misc_net", 4.97, "A", "B", "F", "st", "c", "NC",
           28654, 36.0788, -81.1781, 3495, "job", "1988-03-09", "t1", 1325376018, 36.011293, -82.048315, 0)
    raw = spark.createDataFrame([row], schemas.RAW_TRANSACTIONS)
    out = prepare.prepare(raw, as_of="2024-02-01")
    assert set(schemas.IDENTIFYING_COLUMNS).isdisjoint(out.columns)
    assert "dob" not in out.columns and "trans_date_trans_time" not in out.columns
    r = out.first()
    assert r.age == 35 and r.trans_hour == 0 and r.trans_day_of_week == 3
    assert r.distance_km == pytest.approx(78.6, abs=0.1)


def test_tag_union_by_name_and_position(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, id int")
    by_name = prepare.tag_union({"train": a, "test": b}).orderBy("id").collect()
    assert [(r.id, r.s, r.portion) for r in by_name] == [(1, "x", "train"), (2, "y", "test")]


def test_ln_and_boxcox_edges(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (None,), (float("nan"),), (4.0,)], "x double")
    r = df.select(scalar.ln("x").alias("l"), scalar.boxcox("x", 0.5).alias("b"),
                  scalar.boxcox("x", -1.0).alias("bn")).collect()
    assert r[0].l is None and r[1].l is None and r[2].l is None
    assert [x.b for x in r[:4]] == [None] * 4
    assert r[4].b == pytest.approx(2.0) and r[4].bn == pytest.approx(0.75)


def test_stratified_sample_layout_independent(spark):
    df = spark.range(5000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    fr = {0: 0.2, 1: 1.0}
    a = sampling.stratified_sample(df, "y", fr, 5, "id")
    b = sampling.stratified_sample(df.repartition(7), "y", fr, 5, "id")
    ids_a = sorted(r.id for r in a.collect())
    assert ids_a == sorted(r.id for r in b.collect())
    assert all(r.y == 1 for r in df.where("y = 1").collect())
    assert a.where("y = 1").count() == 500            # fraction 1 keeps the whole stratum
    assert 800 < a.where("y = 0").count() < 1000


def test_missing_stratum_dropped_unless_default(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 3).cast("int"))
    assert sampling.stratified_sample(df, "y", {0: 1.0}, 1, "id").where("y != 0").count() == 0
    assert sampling.stratified_sample(df, "y", {0: 1.0}, 1, "id", default=1.0).count() == 100


def test_folds_cover_range(spark):
    df = spark.range(3000)
    folds = sampling.assign_folds(df, 3, 9, "id").groupBy("fold").count().collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2]
    assert all(900 < r["count"] < 1100 for r in folds)


def test_class_distribution_empty_and_single(spark):
    empty = spark.createDataFrame([], "y int")
    assert distribution.class_distribution(empty, "y").count() == 0
    one = spark.createDataFrame([(1,), (1,)], "y int")
    r = distribution.class_distribution(one, "y").first()
    assert r["count"] == 2 and r.proportion == 1.0


def test_value_counts_excludes_null(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "c1 string, c2 string")
    out = {(r.column, r.value): r["count"] for r in distribution.value_counts(df, ["c1", "c2"]).collect()}
    assert out == {("c1", "a"): 2, ("c2", "x"): 2}


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 1, 2, 3, 456789), 1.5)],
                               "id int, ts timestamp_ntz, v double")
    p = str(tmp_path / "out")
    files.write_csv(df, p)
    back = files.read_csv(spark, p, schema=df.schema)
    assert back.collect() == df.collect()
    with pytest.raises(Exception):
        files.write_csv(df, p)   # default mode refuses to overwrite


def test_profile_schema_roles(spark):
    df = spark.createDataFrame([("a", 1.0, 1)], "cat string, num double, is_fraud int")
    roles = {r.name: r.role for r in files.profile_schema(df).collect()}
    assert roles == {"cat": "categorical", "num": "numeric", "is_fraud": "label"}
    assert files.feature_roles(df) == (["cat"], ["num"])


def test_csv_infer_schema(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("a,b,c,d\n1,2.5,x,2024-01-02 03:04:05\n2,3.5,y,2024-01-03 00:00:00\n")
    df = files.read_csv(spark, str(p), infer=True)
    types = dict(df.dtypes)
    assert types["a"] == "int" and types["b"] == "double" and types["c"] == "string"
    assert df.count() == 2
    typed = files.read_csv(spark, str(p), schema=None)          # no schema, no inference: strings
    assert all(t == "string" for _, t in typed.dtypes)
