import collections

from cardsight.llm import mixing

from .frames import edge_documents, prose


def targets(sizes, weights=(5, 2, 1)):
    """Plain repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {s: 0.0 for s in sizes}, float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        total, spent = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            give = min(left * w[s] / total, 3 * sizes[s] - out[s])
            out[s] += give
            spent += give
        open_ = {s for s in open_ if 3 * sizes[s] - out[s] > 1e-9}
        left -= spent
    return out


def test_targets_copies_and_reruns(spark):
    r = [(i, prose(i, 20 + (i * 37) % 300), f"s{i % 7}" if i % 11 else None) for i in range(900)]
    r += [(2000 + i, prose(5000, 40), "s0") for i in range(500)] + [(5000, "big " * 9000, "tiny"), (5001, None, "empty")]
    df = spark.createDataFrame(r, "doc_id long, text string, source string")
    got = mixing.mix(df, slice_rows=64).collect()
    assert len(got) == len(r)
    sizes = collections.Counter({s: 0 for _, _, s in r})
    for x in got:
        sizes[x.source] += x.size
    want = targets(dict(sizes))
    taken = collections.Counter()
    for x in got:
        assert abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source]) and x.source_size == sizes[x.source]
        assert 0 <= x.copies <= 3
        taken[x.source] += x.copies * x.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= max([x.size for x in got if x.source == s]) * 1.01 + 3
    again = mixing.mix(df.repartition(7), slice_rows=1000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_edges_and_emit(spark):
    docs = edge_documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == sum(x.copies for x in got)
    assert mixing.mix(docs.limit(0)).count() == 0
