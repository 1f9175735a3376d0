import pytest

from cardsight.llm.decontaminate import bins_for, clean, least, search

from .frames import changed, edge_documents, prose
from .test_jaccardjoin import shingle_set


def brute(docs, items, percent=80):
    out = []
    for d, t in docs:
        s = shingle_set(t)
        for i, text in items:
            q = shingle_set(text)
            if q and 100 * len(q & s) >= percent * len(q):
                out.append((d, i, len(q & s), len(q)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def bench(spark):
    long_ = prose(2, 9000).split(" ")
    items = [(1, " ".join(long_[4000:4040])), (2, changed(prose(1, 120), 60)), (3, "one two three"), (4, ""), (5, None), (6, "One"),
             (7, " ".join(long_[100:110])), (8, prose(77, 30)), (9, "a a a a a a a a"), (None, "one"), (8, prose(78, 12))]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("slice_size", [2_000_000, 40])
def test_equals_brute_force_on_edges(spark, slice_size):
    items, b = bench(spark)
    docs = edge_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [x for x in items if x[0] is not None])
    assert got(search(docs, b, slice_size=slice_size)) == want and len(want) > 8
    bad = {r[0] for r in want}
    left = clean(docs, b, slice_size=slice_size)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows if d not in bad or d is None} - (bad - {None})


def test_empty_tables(spark):
    _, b = bench(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert search(none, b).count() == 0
    assert search(edge_documents(spark), b.limit(0)).count() == 0
    assert clean(edge_documents(spark), b.limit(0)).count() == edge_documents(spark).count()


def test_signatures_grow_with_the_document_and_miss_rarely():
    import numpy as np
    sizes = [bins_for(c, 34, 80, 1e-9) for c in range(5, 16)]
    assert sizes == sorted(sizes) and bins_for(10, 1, 80, 1e-9) == 64
    h = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    assert len(least(h, 64)) == 5000 and len(least(h, 6)) == 64
