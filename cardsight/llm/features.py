"""Hashed term features of whole texts for the classifiers (numpy inside Spark tasks).

A document's terms are, each hashed into one of ``2 ** bits`` slots:

* its words, lower-cased, without punctuation around them;
* the shape of each word: capitals, digits, the marks at its end, and whether it repeats
  the word before (so shouting, tables, mark-up noise and stutter are terms of their own).

The slot of a term is the top bits of its 64-bit hash. Nothing but the text is read.
"""

from __future__ import annotations

import numpy as np

from .text import U64, _SPACE, Piece, mix, words

# bytes that do not count as a part of a bare word: ASCII punctuation and spaces
_MARK = _SPACE.copy()
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int32)
_LOWER[97:123] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


def bare_words(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the words between spaces and ASCII marks."""
    w = words(piece, _MARK)
    return w.hash, w.doc


def shapes(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the shape of every space-separated word."""
    w = words(piece)
    if not len(w.hash):
        return w.hash, w.doc

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(piece.data) + 1, np.int32)
        np.cumsum(flags[piece.data], out=total[1:])
        return total[w.end] - total[w.start]

    length = w.end - w.start
    upper, lower, digit = per_word(_UPPER), per_word(_LOWER), per_word(_DIGIT)
    case = np.where(upper > 1, 2, np.where(upper == 1, 1, 0)) * 2 + (lower > 0)
    last = piece.data[w.end - 1].astype(np.int64)
    before = np.where(length > 1, piece.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    last = np.where(_MARK[last], last, 0)
    before = np.where(_MARK[before] & (last > 0), before, 0)
    repeat = np.zeros(len(length), bool)
    repeat[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    size = np.minimum(np.log2(length + 1).astype(np.int64), 7)
    code = ((((case * 2 + (digit > 0)) * 256 + last) * 256 + before) * 2 + repeat) * 8 + np.where(repeat, 0, size)
    return mix(code.astype(np.uint64) * U64(0x9FB21C651E98DF25) + U64(77)), w.doc


def term_counts(h: np.ndarray, doc: np.ndarray, n_docs: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows as (row bounds, slots, counts) of hashed terms."""
    slot = (h >> U64(64 - bits)).astype(np.int64)
    key, n = np.unique((doc.astype(np.int64) << bits) | slot, return_counts=True)
    bounds = np.searchsorted(key, np.arange(n_docs + 1, dtype=np.int64) << bits)
    return bounds, key & ((1 << bits) - 1), n


__all__ = ["bare_words", "shapes", "term_counts"]
