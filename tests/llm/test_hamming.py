import random

import pytest

from cardsight.llm.hamming import top_k


def brute(items, queries, k, dims):
    code = lambda v: [1 if x is not None and x > 0 else 0 for x in v] + [0] * (dims - len(v))
    out = []
    for q, v in queries:
        if q is None or not v:
            continue
        c = code(v)
        near = sorted((sum(a != b for a, b in zip(c, code(x))), i) for i, x in items if i is not None and x)
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("dims,bits,k", [(24, 8, 5), (20, 8, 3)])
def test_equals_brute_force(spark, dims, bits, k):
    r = random.Random(dims)
    base = [r.uniform(-1, 1) for _ in range(dims)]
    items = [(i, [r.uniform(-1, 1) for _ in range(dims)]) for i in range(120)]
    items += [(200 + i, base) for i in range(60)] + [(300 + i, [-x if j == i else x for j, x in enumerate(base)]) for i in range(dims)]
    items += [(400, None), (401, []), (None, base), (402, base[:5]), (403, [None] * dims), (200, base)]
    queries = [x for x in items if x[0] is None or x[0] % 20 == 0]
    schema = "vec_id long, embedding array<double>, code string, distance int"
    frame = lambda rows: spark.createDataFrame([(*x, "c", 1) for x in rows], schema)
    got = sorted(tuple(x) for x in top_k(frame(items), frame(queries), k, bits).collect())
    assert got == brute(items, queries, k, dims)


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in top_k(one, one, 5, 8).collect()) == [(1, 1, 1, 0), (1, 2, 2, 1), (2, 1, 2, 0), (2, 2, 1, 1)]
    assert top_k(one.limit(0), one.limit(0), 5, 8).count() == 0
