import math

import numpy as np
import pytest

from cardsight.llm.whitening import deviations, fit_whitening, lattice, leading, op12_whitening, whiten


def plain(vectors, k=4):
    """Rows, fit list and eigenpairs by numpy's own solver."""
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors
         if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in x}), np.int64)
    mean = fit.mean(axis=0)
    e, u = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    return x, fit, mean, e[::-1][:k], u[:, ::-1][:, :k], e.sum()


def check(rows, vectors, k=4):
    x, fit, mean, e, u, trace = plain(vectors, k)
    k = len(e)
    n, sums = len(fit), fit.sum(axis=0)
    assert len(rows) == k * len(x)
    by = {}
    for r in sorted(rows, key=lambda r: (str(r.vec_id), r.component)):
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
        assert 0 <= r.identity_error <= 1e-9
    assert len({r.identity_error for r in rows}) == 1
    x.sort(key=lambda p: str(p[0]))
    for c in range(1, k + 1):
        want = [(np.array(v) - mean) @ u[:, c - 1] / math.sqrt(e[c - 1]) for _, v in x]
        got = [r.whitened for r in by[c]]
        sign = np.sign(np.dot(want, got))
        assert np.allclose(np.array(got) * sign, want, atol=1e-8)
        assert [r.deviation for r in by[c]] == [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))) for _, v in x]


def test_equals_a_plain_solver_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(op12_whitening(spark, sf).collect(), [(r.vec_id, r.embedding) for r in e])


def test_edges(spark):
    r = np.random.default_rng(4)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(r.standard_normal((60, 5)) * [9, 5, 3, 2, 1])]
    vectors += [(60 + i, vectors[0][1]) for i in range(40)]                 # many copies count once in the fit
    vectors += [(3, vectors[7][1]), (None, vectors[9][1]), (200, [0.0] * 5), (201, [-0.0, -1 / 512, 1e-9, -1e-9, 0.5])]
    bad = [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [float("nan")] * 5), (303, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (304, [0.0, float("-inf"), 0.0, 0.0, 0.0])]
    rows = [(i, v, "x", 1, 2, 3.0) for i, v in vectors + bad]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int, component int, whitened double").repartition(3)
    got = whiten(frame).collect()
    one = {str(i) for i, v in vectors}
    assert {str(r.vec_id) for r in got} == one
    unique = [(n, v) for n, (_, v) in enumerate(vectors)]
    again = spark.createDataFrame(unique, "vec_id long, embedding array<double>")
    check(whiten(again).collect(), unique)
    x = [[math.floor(256 * c) for c in v] for _, v in vectors]
    assert sorted(map(str, [r.x for r in lattice(frame).collect()])) == sorted(map(str, x))


def test_few_vectors_and_no_variance(spark):
    make = lambda rows: whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).count() == 0 and make([(1, None)]).count() == 0 and make([(1, [])]).count() == 0
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0        # one distinct vector
    line = make([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])]).collect()
    assert {r.component for r in line} == {1} and [r.explained for r in line] == pytest.approx([1.0] * 3)
    assert sorted(r.whitened for r in line) == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)], abs=1e-12)
    mixed = make([(1, [1.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0, 3.0])])    # shorter ones end in zeros
    check(mixed.filter("component <= 2").collect(), [(1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0]), (3, [0.0, 0.0, 3.0])], 2)
    huge = make([(1, [1e30, 0.0]), (2, [3e7, 1.0]), (3, [1.0, 2.0])]).collect()  # 1e30 * 256 is no long
    assert {r.vec_id for r in huge} == {2, 3}


def test_deviation_beyond_a_long_is_null():
    from cardsight.llm.whitening import Centre
    c = Centre(4, [0, 0], np.zeros(2, np.int64), np.zeros(2))
    assert deviations(np.array([[1, 2], [2 ** 31, 0]]), c) == [80, None]


@pytest.mark.parametrize("n", [1, 2, 3, 6, 40, 130])
def test_leading_eigenvectors(n):
    r = np.random.default_rng(n)
    q = np.linalg.qr(r.standard_normal((n, n)))[0]
    spectra = [np.sort(r.random(n))[::-1], np.ones(n), np.r_[np.ones(n // 2 + 1), np.zeros(n - n // 2 - 1)],
               np.r_[1.0, 1.0 + 1e-14, 1.0 - 1e-9, np.linspace(0.5, 0, n)][:n], 10.0 ** -np.arange(n)]
    for e in spectra:
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        k = min(4, n)
        values, vectors = leading(a, k)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1][:k], atol=1e-13)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-11
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13


def test_same_components_on_any_layout(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a, b = (fit_whitening(lattice(frame.repartition(p))) for p in (1, 7))
    assert (a.vectors == b.vectors).all() and (a.values == b.values).all()
