import random

from cardsight.llm import secrets

from .frames import edge_documents, prose


def documents():
    r = random.Random(3)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(160):
        text = prose(900 + i, 40)
        if i % 4 == 0:
            text += f' token = "{hexes(40)}" ' + prose(i, 5)
        if i % 4 == 1:
            text += f" see https://example.org/archive/{'word' * 6}/index.html and {r.randrange(10**15, 10**16)} " + prose(i, 5)
        if i % 4 == 2:
            text += " internationalisationofeverything anextraordinarilylongword"
        rows.append((i, text))
    return rows


def test_true_findings_stand_out(spark):
    rows = documents()
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), per_class=60).collect()
    true = [r for r in got if r.length == 40 and r.doc_id % 4 == 0]
    false = [r for r in got if r.doc_id % 4 != 0]
    assert len(true) == 40 and len(false) >= 100
    assert sum(r.predicted for r in true) >= 38 and sum(r.predicted for r in false) <= 2


def test_given_findings_and_edges(spark):
    docs = edge_documents(spark)
    assert secrets.scan(docs.limit(0)).count() == 0
    got = secrets.scan(docs).collect()
    assert got and all(r.predicted == 0 for r in got)          # no true finding to learn from
    df = spark.createDataFrame(documents(), "doc_id long, text string")
    found = secrets.candidates(df).select("doc_id", "place", "part", (secrets.F.length("candidate") == 40).cast("int").alias("label"))
    out = secrets.scan(df, found).collect()
    assert {r.predicted for r in out if r.length == 40} == {1}
