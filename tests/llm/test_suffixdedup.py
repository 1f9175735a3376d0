import hashlib

import pytest

from cardsight.llm.suffixdedup import COVER, PERIOD, remove_repeats

from .frames import edge_documents


def brute(rows, width):
    """doc rows [(id, text)] -> {(id, n_bytes, n_removed, n_spans, sha)} by a dictionary of strings."""
    low = {}
    key = lambda i: float("inf") if i is None else i
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - width + 1):
            s = b[p:p + width]
            low[s] = min(low.get(s, float("inf")), key(i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if low[b[p:p + width]] < key(i):
                gone[p:p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_cover_reaches_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows_of(remove_repeats(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert any(n for _, _, n, _, _ in got)


@pytest.mark.parametrize("width", [35, 50])
def test_edges(spark, width):
    docs = edge_documents(spark)
    assert rows_of(remove_repeats(docs, width)) == brute([(r.doc_id, r.text) for r in docs.collect()], width)


def test_empty_and_kept_text(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    a, b = "first " * 30, "x" * 40 + "first " * 30 + "y" * 20
    out = {r.doc_id: bytes(r.kept).decode() for r in
           remove_repeats(spark.createDataFrame([(2, b), (1, a)], "doc_id long, text string")).collect()}
    assert out == {1: a, 2: "x" * 40 + "y" * 20}
