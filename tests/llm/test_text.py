import re

import numpy as np
import pyarrow as pa
import pytest

from cardsight.llm.linededup import LINE_BITS, PART_BITS, key_of
from cardsight.llm.text import _FOLD, _SPACE, looked_up, pieces, words


def hashes(text):
    return words(next(iter(pieces(pa.array([text]))))).hash.tolist()


def rearranged(steps):
    """Two words of 2 ** steps letters that collide under any polynomial modulo 2 ** 64 from 1,024 letters on."""
    x = "a"
    for _ in range(steps):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("steps", [3, 10, 11, 12])
def test_rearranged_letters_differ(steps):
    a, b = hashes(" ".join(rearranged(steps)))
    assert a != b


def test_equal_hashes_mean_equal_words():
    rng = np.random.default_rng(5)
    tokens = ["".join(rng.choice(list("abABéc"), n)) for n in rng.integers(1, 40, 5_000)]
    tokens += ["x" * n for n in range(1, 200)] + ["abcdefgh", "abcdefghi", "ABCDEFGHI", "abcdefgh\0"]
    fold = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in tokens]
    got = hashes("\n".join(tokens))
    assert len(got) == len(tokens)
    assert len(set(got)) == len(set(fold)) == len(set(zip(got, fold)))


def test_hash_does_not_depend_on_the_place():
    assert len(set(hashes("ninebytes " * 50 + "ninebytes"))) == 1


def test_line_keys_rise_with_partition_block_and_line():
    # 2 ** 18 partitions and more: several terabytes of text
    places = [(0, 0), (0, 1), (1, 0), ((1 << 17) + 1, 3), (1 << 18, 0), ((1 << 24) - 1, (1 << PART_BITS) - 1)]
    keys = np.concatenate([key_of(p << 32 | n, np.array([0, 7, (1 << LINE_BITS) - 1])) for p, n in places])
    assert (np.diff(keys) > 0).all() and keys[0] == 0
    with pytest.raises(OverflowError):
        key_of(1 << 24 << 32, np.array([0]))
    with pytest.raises(OverflowError):
        key_of(1 << PART_BITS, np.array([0]))


def test_block_of_undoes_key_of(spark):
    from cardsight.llm.linededup import block_of
    blocks = [0, 5, 1 << 32, (1 << 18) << 32 | 9, ((1 << 24) - 1) << 32 | 2047]
    rows = [(b, int(key_of(b, np.array([n]))[0])) for b in blocks for n in (0, 12345)]
    df = spark.createDataFrame(rows, "block long, line long").withColumn("found", block_of())
    assert df.filter("block = found").count() == len(rows)


def test_looked_up_equals_indexing():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    for table in (_FOLD, ~_SPACE):
        out = looked_up(table, data)
        assert out.dtype == table.dtype and (out == table[data]).all()
    assert len(looked_up(_FOLD, data[:0])) == 0
