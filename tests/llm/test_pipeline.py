import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as cp  # noqa: E402
from cardsight.llm import common, decontaminate, jaccardjoin, linededup  # noqa: E402

from .frames import changed, edge_documents, prose  # noqa: E402

MID = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_run_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        out = common.stored(stage(spark, docs, MID), "stage")
        assert out.columns == COLUMNS and dict(out.dtypes) == dict(docs.dtypes), name
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] > 0.5 * counts[0]
    # the decisions hold on what is left
    bench = spark.read.parquet(f"{MID}/benchmark.parquet")
    assert decontaminate.search(docs, bench).count() == 0
    assert jaccardjoin.join(docs).filter("doc_id <> component_id").count() == 0
    mixed = cp.STAGES[-1][1](spark, docs, MID)
    assert mixed.count() == counts[-1]
    taken = mixed.groupBy("source").sum("taken", "size").collect()
    assert all(r["sum(taken)"] <= 3 * r["sum(size)"] for r in taken)


def test_stages_stand_edges(spark):
    docs = edge_documents(spark)
    for df in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, df, MID)
            assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes), name
            assert out.count() <= df.count()
        cp.STAGES[-1][1](spark, df, MID).count()


def test_line_stage_drops_only_what_it_empties(spark):
    first = [(100 * g, [prose(1000 + 10 * g + j, 14) for j in range(10)]) for g in range(20)]
    near = [(i + k, [changed(line, 14, f"z{k}") if (j + k) % 2 else line for j, line in enumerate(lines)]) for i, lines in first for k in (1, 2, 3)]
    mixed = [(5000, first[0][1][:3] + [prose(7, 20)]), (5001, first[1][1][:1])]
    rows = [(i, "\n".join(x), "s", len("\n".join(x))) for i, x in first + near + mixed] + [(9000, None, "s", 0), (9001, " \n", None, 2), (9002, "", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    out = {r.doc_id: r for r in cp.line_stage(spark, docs, MID).collect()}
    assert set(out) == {i for i, _ in first} | {5000, 9000, 9001, 9002}
    assert out[5000].text == mixed[0][1][3] and out[5000].n_chars == len(mixed[0][1][3])
    assert all(out[i].text == "\n".join(x) for i, x in first)


def test_representatives_keep_the_first_of_a_group(spark):
    a = prose(1, 200)
    rows = [(5, a, "x"), (3, changed(a, 120), "y"), (9, prose(2, 90), None), (None, a, "z"), (4, None, "w"), (6, "", "v")]
    out = jaccardjoin.representatives(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r.doc_id, r.source) for r in out.collect()} == {(3, "y"), (9, None), (4, "w"), (6, "v")}


def test_clean_documents_stay_as_they_are(spark):
    rows = [(i, "\n".join(prose(100 + 7 * i + j, 25) for j in range(3))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.dedup(df).collect()) == rows
    assert sorted((r.doc_id, r.text) for r in jaccardjoin.representatives(df).collect()) == rows
