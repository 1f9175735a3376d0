"""Checked CSV, column profile, index tables and pipelines saved under other names."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler

from cardsight.operators import features
from cardsight.operators.indexing import TableIndexer
from cardsight.sources import files, models


def write(path, text):
    path.mkdir()
    (path / "part.csv").write_text(text)
    return str(path)


def test_every_line_is_typed_or_rejected(spark, tmp_path):
    schema = "id int, day date, amount double, note string"
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(schema)
    lines = ["1,2020-01-01,1.5,ok", '2,2020-01-02,2.5,"quoted, with comma"', "3,2020-01-03,3.5", "4,2020-01-04,4.5,a,b", "x,2020-01-05,5.5,id",
             "6,soon,six,two", "7,,,", "8,2020-01-08,8.5,", '9,2020-01-09,bad,"a ""quote"""', ""]
    path = write(tmp_path / "in", "id,day,amount,note\n" + "\n".join(lines) + "\n")
    typed, rejected = files.ingest_csv(spark, path, str(tmp_path / "out"), schema)
    assert typed.columns == schema.names and sorted(r.id for r in typed.collect()) == [1, 2, 7, 8]
    assert typed.where("id = 2").first().note == "quoted, with comma" and typed.where("id = 7").first().day is None
    got = {r.line: r.reason for r in rejected.collect()}
    assert got == {lines[2]: "fields", lines[3]: "fields", lines[4]: "id", lines[5]: "day,amount", lines[8]: "amount"}
    assert typed.count() + rejected.count() == len([x for x in lines if x])
    one = files.read_csv_checked(spark, path, schema).select("id", "_reason")      # a narrow read still notices
    assert sum(r._reason is not None for r in one.collect()) == 5


def test_profile_and_preview(spark):
    rows = [(i, float(i % 11) if i % 4 else None, f"s{i % 500}", i % 2 == 0, float("nan") if i % 10 == 0 else 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, x double, s string, b boolean, z double").repartition(5)
    p = {r.name: r for r in files.profile_columns(df).collect()}
    assert [p[c].position for c in df.columns] == [0, 1, 2, 3, 4]
    assert (p["x"].rows, p["x"].nulls, p["x"].nan, p["x"].min, p["x"].max) == (4000, 1000, 0, "0.0", "10.0")
    assert p["z"].nan == 400 and p["z"].mean == 1.0 and p["z"].n_distinct == 1 and p["s"].mean is None and p["b"].n_distinct == 2
    assert abs(p["id"].n_distinct - 4000) <= 5 * files.distinct_error() * 4000 and abs(p["s"].n_distinct - 500) <= 5 * files.distinct_error() * 500
    assert p["x"].mean == pytest.approx(sum(r[1] for r in rows if r[1] is not None) / 3000) and p["x"].q1 <= p["x"].median <= p["x"].q3
    empty = {r.name: r for r in files.profile_columns(df.limit(0)).collect()}
    assert empty["x"].rows == 0 and empty["x"].q1 is None and empty["x"].n_distinct == 0
    assert [r.id for r in files.preview(df, ["x", "id"], 3).collect()] == [0, 4, 8]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(i, "abc"[min(i % 5, 2)] if i % 7 else None, f"w{i % 3}", float(i)) for i in range(300)],
                                 "id long, a string, b string, x double")


def test_table_index_equals_the_array_index(spark, words, tmp_path):
    fit, rest = words.where("a IS NULL OR a <> 'b'"), words
    got = {}
    for kind in ("array", "table"):
        stages = features.feature_stages(["a", "b"], ["x"], use_pairwise=False, on_invalid="keep", indexer=kind)
        model = Pipeline(stages=stages).fit(fit)
        path = models.save_model(model, str(tmp_path / kind))
        for m in (model, models.load_model(path)):
            out = m.transform(rest)
            rows = {r.id: (r.a_index, r.b_index, r.final_features) for r in out.select("id", "a_index", "b_index", "final_features").collect()}
            assert len(rows) == 300 and got.setdefault("rows", rows).keys() == rows.keys()
            assert all(str(got["rows"][i]) == str(rows[i]) for i in rows)
    assert {r[0] for r in got["rows"].values()} == {0.0, 1.0, 2.0}      # c, a, and the bucket of b and NULL


def test_table_index_on_unknown_values(spark, words):
    fit = words.where("a = 'a'")
    make = lambda how: TableIndexer(inputCols=["a"], outputCols=["a_index"], handleInvalid=how).fit(fit)
    assert make("skip").transform(words).count() == words.where("a = 'a'").count()
    with pytest.raises(PySparkException, match="unknown value"):
        make("error").transform(words).collect()
    none = TableIndexer(inputCols=["a"], outputCols=["a_index"]).fit(words.where("a = 'none'"))
    assert {r.a_index for r in none.transform(words).collect()} == {0.0}
    hot = OneHotEncoder(inputCols=["a_index"], outputCols=["v"]).fit(make("keep").transform(words.limit(5))).transform(make("keep").transform(words))
    assert {r.v.size for r in hot.collect()} == {1}


def foreign(path, model, change):
    for i, stage in enumerate(model.stages):
        folder = f"{path}/stages/{i}_{stage.uid}/metadata"
        part = next(f for f in os.listdir(folder) if f.startswith("part-"))
        with open(f"{folder}/{part}") as f:
            stored = change(json.loads(f.read()))
        with open(f"{folder}/{part}", "w") as f:
            f.write(json.dumps(stored) + "\n")
        crc = f"{folder}/.{part}.crc"
        if os.path.exists(crc):
            os.remove(crc)


def rename(stored):
    if stored["class"].startswith("cardsight."):
        stored["class"] = "some.package.processing." + stored["class"].rsplit(".", 1)[1]
        if "Log" in stored["class"]:
            stored["paramMap"] = {"input_cols": stored["paramMap"]["inputCols"], "output_cols": ["ln_x", "ln_y"]}
            stored["defaultParamMap"] = {"input_cols": None, "output_cols": None}
        if "Pairwise" in stored["class"]:
            stored["paramMap"]["outputCols"] = ["x*y", "x+y", "x-y"]
    return stored


def test_pipelines_saved_under_other_names(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 7 + 1)) for i in range(1, 60)], "x double, y double")
    stages = [features.LogTransformer(inputCols=["x", "y"]), features.PairwiseTransformer(inputCols=["x", "y"]),
              features.BoxCoxTransformer(inputCol="x", outputCol="b", alpha=0.5),
              VectorAssembler(inputCols=["ln_x", "ln_y", "x*y", "x+y", "x-y", "b"], outputCol="v")]
    ours = Pipeline(stages=stages).fit(df)
    path = models.save_model(ours, str(tmp_path / "m"))
    foreign(path, ours, rename)
    with pytest.raises(Exception):
        PipelineModel.load(path)
    loaded = models.load_foreign(spark, path)
    assert [s.uid for s in loaded.stages] == [s.uid for s in ours.stages] and loaded.uid == ours.uid
    assert [r.v for r in loaded.transform(df).select("v").collect()] == [r.v for r in ours.transform(df).select("v").collect()]
    with pytest.raises(ValueError, match="no stage is known"):
        models.load_foreign(spark, path, classes={"LogTransformer": features.LogTransformer})
    foreign(path, ours, lambda s: s | {"paramMap": s["paramMap"] | {"gamma": 2.0}} if "BoxCox" in s["class"] else s)
    with pytest.raises(ValueError, match="gamma"):
        models.load_foreign(spark, path)
    foreign(path, ours, lambda s: s | {"paramMap": {k: v for k, v in s["paramMap"].items() if k != "gamma"}
                                       | ({"outputCols": ["p", "q", "r"]} if "Pairwise" in s["class"] else {})})
    with pytest.raises(ValueError, match="writes"):
        models.load_foreign(spark, path)
