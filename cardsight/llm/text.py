"""Vectorised tokenising and hashing of whole text columns (numpy inside Spark tasks).

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z lower-cased. Every function
works on the byte buffer of an Arrow string column, in pieces of whole documents of about
``PIECE`` bytes, so memory follows the piece (or the longest document), not the partition.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
SHINGLE = 5

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]          # A-Z hash as a-z
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)   # masks of the first 0 to 8 bytes
_STEP = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_STEP), -1, 2**64))
_tables: dict[int, np.ndarray] = {}


def _table(step: np.uint64, n: int) -> np.ndarray:
    """``step ** 0 .. n-1`` (at least) modulo 2**64; grows with the longest piece seen."""
    have = _tables.get(int(step))
    if have is None or len(have) < n:
        have = np.full(max(4096, 1 << (n - 1).bit_length()), step, dtype=np.uint64)
        have[0] = 1
        _tables[int(step)] = have = np.multiply.accumulate(have)
    return have


def powers(n: int) -> np.ndarray:
    return _table(_STEP, n)


def inverse_powers(n: int) -> np.ndarray:
    return _table(_INVERSE, n)


class Prints:
    """Fingerprints of short strings of a piece (tens of bytes): prefix sums of byte value times a power of
    the place, moved back to place 0 by the inverse power. Strings of 1,024 bytes and more can be made to
    collide; words have :func:`word_hashes`."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.multiply(values[data], powers(len(data))[:len(data)], out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end]
        h -= self.sums[start]
        h *= inverse_powers(len(self.sums))[start]
        return mix(h)


def looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` for bytes and a table of 256 bytes or truths, without an index of eight bytes a byte."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that any bits can pick a bucket."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, A-Z as a-z. Eight bytes at a time are mixed with their place (the first
    eight with the length) and added up, so no rearrangement of letters cancels out as it can in a polynomial;
    words of up to eight bytes and equal length never collide."""
    n, size = len(data), end - start
    folded = np.zeros(n + 8, np.uint8)
    folded[:n] = looked_up(_FOLD, data)
    eights = np.ndarray(n + 1, "<u8", folded, strides=(1,))      # the eight bytes from each position on
    h = mix((eights[start] & _FIRST[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64) * _STEP))
    longer = np.flatnonzero(size > 8)
    if len(longer):
        more = (size[longer] - 1) // 8
        first = np.cumsum(more) - more
        nth = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(start[longer], more) + 8 * nth
        left = np.minimum(np.repeat(end[longer], more) - at, 8)
        rest = mix((eights[at] & _FIRST[left]) ^ mix(nth.astype(np.uint64) * _INVERSE))
        h[longer] = mix(h[longer] + np.add.reduceat(rest, first))
    return h


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Piece(NamedTuple):
    """Whole documents of one piece; ``first`` is the row of the first one in the batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """Cut a text column into runs of whole documents of about ``size`` bytes."""
    data, offsets = string_buffer(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield Piece(at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
        at = end


class Words(NamedTuple):
    """Words of a piece: byte ranges, document (row in the piece) and 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def counts(self, n_docs: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n_docs)


def words(piece: Piece, spaces: np.ndarray = _SPACE) -> Words:
    data, offsets = piece.data, piece.offsets
    n = len(data)
    solid = looked_up(~spaces, data)
    first = solid.copy()            # a word starts: no space, and a space or another document before
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = solid[inner]
    start = np.flatnonzero(first)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, np.uint64))
    last = solid.copy()             # a word ends: a space or another document follows
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1] - 1
    inner = inner[inner >= 0]
    last[inner] = solid[inner]
    end = np.flatnonzero(last) + 1
    counts = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    return Words(start, end, doc, word_hashes(data, start, end))


_COMBINE = powers(64)[1:64] * U64(0xD1342543DE82EF95)


def shingles(w: Words, n_docs: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every k-word shingle; a document of 1 to k-1 words has the whole
    sequence as its one shingle. Repeats are kept; hashes of one document are adjacent."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = w.counts(n_docs)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    total = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k if len(total) else 0):
        total += w.hash[j:n - k + 1 + j] * _COMBINE[j]
    whole = w.doc[:len(total)] == w.doc[k - 1:] if len(total) else np.zeros(0, bool)
    h, d = mix(total[whole] + U64(k)), w.doc[:len(total)][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] += w.hash[bounds[short[has]] + j] * _COMBINE[j]
        extra = mix(extra + counts[short].astype(np.uint64))
        h, d = np.concatenate((h, extra)), np.concatenate((d, short))
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def by_document(values: np.ndarray, doc: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, its values) for adjacent documents; documents without values come empty."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    for i in range(n_docs):
        yield i, values[bounds[i]:bounds[i + 1]]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) > 1 else values


def long_bits(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's signed long, bit for bit."""
    return x.view(np.int64)
