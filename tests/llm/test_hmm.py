import math

import numpy as np

from cardsight.llm import hmm

from .frames import edge_documents


def plain_forward(seq, m):
    a = m.start * m.emit[seq[0]]
    for s in seq[1:]:
        a = (a @ m.move) * m.emit[s]
    return math.log10(a.sum())


def random_model(k=3, v=9, seed=4):
    r = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(r.random(k), 0), norm(r.random((k, k)), 1), norm(r.random((v, k)), 0))


def test_forward_equals_the_plain_recursion():
    r, m = np.random.default_rng(1), random_model()
    sizes = np.array([1, 40, 7, 1, 133])
    symbols = r.integers(0, 9, sizes.sum()).astype(np.uint16)
    starts = np.cumsum(sizes) - sizes
    got = hmm.forward(symbols, starts, sizes, m)
    assert np.allclose(got, [plain_forward(symbols[a:a + n], m) for a, n in zip(starts, sizes)])


def test_expected_counts_raise_the_likelihood():
    r, m = np.random.default_rng(2), random_model()
    sizes = np.full(60, 30)
    symbols = np.concatenate([np.tile([0, 1, 2] if i % 2 else [5, 6, 7], 10) for i in range(60)]).astype(np.uint16)
    starts, first = np.cumsum(sizes) - sizes, np.ones(60, bool)
    last = hmm.forward(symbols, starts, sizes, m).sum()
    for _ in range(6):
        begun, moves, emits = hmm.expected(symbols, starts, sizes, first, m)
        assert abs(emits.sum() - sizes.sum()) < 0.5 and abs(moves.sum() - (sizes - 1).sum()) < 0.5
        m = hmm.Model(begun / begun.sum(), moves / moves.sum(1, keepdims=True), (emits + 1e-9) / (emits + 1e-9).sum(0))
        now = hmm.forward(symbols, starts, sizes, m).sum()
        assert now >= last - 1e-3
        last = now
    assert r is not None


def test_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hmm.score(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.n_known <= r.n_tokens and r.score < 0 for r in got)


def test_edges(spark):
    docs = edge_documents(spark)
    got = hmm.score(docs, rounds=1).collect()
    assert len(got) == docs.count()
    empty = [r for r in got if r.doc_id in (3, 4, 5)]
    assert {r.n_tokens for r in empty} == {1} and len({(r.base_score, r.score) for r in empty}) == 1
    assert hmm.score(docs.limit(0)).count() == 0
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
