"""License scans (operator 11): which licence texts, or parts of them, a document carries.

The words of all templates and phrases go into one generalised suffix automaton, a few hundred states that
are broadcast. A document streams through it word by word; state and length after each word are its matching
statistics: the longest piece of any template that ends there. From them follows, for every template, the longest
piece of that template that ends at the word (the deepest state on the suffix links that the template has). Pieces
of ``LONG`` words or more (or whole shorter templates) that cannot be extended are anchors, and anchors in the
same order in document and template are chained into spans; a span's share is the part of the template's words
that its chain covers. Phrases are templates that count only where they stand whole.

Only stretches in which every two neighbouring words are neighbours in some template can hold a piece, and one
vectorised lookup finds these; prose never reaches the automaton. Documents are independent: no row moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table
from .text import pieces, word_hashes, words

LONG = 4          # words of an anchor
GAP = 12          # words between two anchors of a chain, beyond those that the template has there
SHARE = 0.6       # part of a template that a span must cover to give its label

# The phrases of the base labels.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Notices of common public licences, as their authors ask them to be quoted.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
               "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("reserved", "All rights reserved."),
]

_GAP_BYTE = np.ones(256, bool)      # between words: all of ASCII but digits and letters
_GAP_BYTE[48:58] = _GAP_BYTE[65:91] = _GAP_BYTE[97:123] = _GAP_BYTE[128:] = False


def word_list(text: str) -> list[bytes]:
    """The words of one text, lower-cased."""
    data = text.encode().lower()
    return bytes(32 if _GAP_BYTE[b] else b for b in data).split()


class Automaton(NamedTuple):
    """Generalised suffix automaton of word sequences; state 0 is the start."""

    labels: list[str]
    lengths: np.ndarray             # words of each template
    is_phrase: np.ndarray
    vocabulary: dict[bytes, int]
    step: list[dict[int, int]]      # transitions
    longest: list[int]              # length of a state's longest string
    link: list[int]
    ends: list[dict[int, list[int]]]    # template -> places where the state's strings end in it
    depth: np.ndarray               # (state, template): longest string on the suffix links that the template has
    at: np.ndarray                  # (state, template): the state that has it


def build(templates: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> Automaton:
    """The automaton of all templates and phrases of at least two words."""
    items = [(label, word_list(text), False) for label, text in templates] + [(label, word_list(text), True) for label, text in phrases]
    items = [i for i in items if len(i[1]) > 1]
    vocabulary: dict[bytes, int] = {}
    step, longest, link, ends = [{}], [0], [-1], [{}]

    def state(transitions: dict, length: int, to: int) -> int:
        step.append(transitions), longest.append(length), link.append(to), ends.append({})
        return len(step) - 1

    def split(p: int, q: int, c: int) -> int:
        """The state of p's longest string and c, taken out of q if q holds longer ones."""
        if longest[q] == longest[p] + 1:
            return q
        clone = state(dict(step[q]), longest[p] + 1, link[q])
        link[q] = clone
        while p != -1 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return clone

    def extend(last: int, c: int) -> int:
        if c in step[last]:
            return split(last, step[last][c], c)
        new = state({}, longest[last] + 1, 0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            link[new] = split(p, step[p][c], c)
        return new

    for t, (_, ws, _) in enumerate(items):
        last = 0
        for place, w in enumerate(ws):
            last = extend(last, vocabulary.setdefault(w, len(vocabulary)))
            ends[last].setdefault(t, []).append(place)
    n, order = len(step), sorted(range(1, len(step)), key=lambda s: -longest[s])
    for s in order:                 # a state's strings end wherever those of the states below it do
        for t, places in ends[s].items():
            ends[link[s]].setdefault(t, []).extend(places)
    ends[0] = {}
    depth, at = np.zeros((n, len(items)), np.int64), np.zeros((n, len(items)), np.int64)
    for s in reversed(order):
        depth[s], at[s] = depth[link[s]], at[link[s]]
        for t in ends[s]:
            depth[s, t], at[s, t] = longest[s], s
    return Automaton([i[0] for i in items], np.array([len(i[1]) for i in items], np.int64), np.array([i[2] for i in items], bool),
                     vocabulary, step, longest, link, ends, depth, at)


def statistics(a: Automaton, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics: state and length of the longest known string that ends at each word."""
    states, lengths, s, n = [], [], 0, 0
    for c in ids:
        while s and c not in a.step[s]:
            s = a.link[s]
            n = a.longest[s]
        s, n = (a.step[s][c], n + 1) if c in a.step[s] else (0, 0)
        states.append(s), lengths.append(n)
    return np.array(states, np.int64), np.array(lengths, np.int64)


class Anchor(NamedTuple):
    word: int       # first word in the document
    place: int      # first word in the template
    size: int


class Span(NamedTuple):
    template: int
    first_word: int
    last_word: int
    covered: int


def anchors(a: Automaton, ids: list[int], first: int, long: int) -> dict[int, list[Anchor]]:
    """Template -> its pieces in a stretch of words that starts at word ``first``, longest to the left and right."""
    states, lengths = statistics(a, ids)
    piece = np.minimum(lengths[:, None], a.depth[states])
    grows = np.zeros(piece.shape, bool)
    grows[:-1] = piece[1:] == piece[:-1] + 1
    need = np.where(a.is_phrase, a.lengths, np.minimum(a.lengths, long))
    out: dict[int, list[Anchor]] = {}
    for i, t in zip(*np.nonzero((piece >= need) & ~grows)):
        size = int(piece[i, t])
        for end in a.ends[a.at[states[i], t]][t]:
            out.setdefault(int(t), []).append(Anchor(first + int(i) - size + 1, end - size + 1, size))
    return out


def best_chain(found: list[Anchor], reach: int, gap: int) -> list[tuple[Anchor, int]]:
    """The anchors (in order of word) of the chain that covers most of the template, with what each adds.

    A following anchor ends later in document and template; where two overlap, the words count once. Words
    in between may be as many as the template has there, and ``gap`` more."""
    best, before, added = [], [], []
    first = 0
    for j, b in enumerate(found):
        while found[first].word + found[first].size + reach + gap < b.word:
            first += 1
        score, back, gain = b.size, -1, b.size
        for i in range(first, j):
            p = found[i]
            over = max(p.word + p.size - b.word, p.place + p.size - b.place, 0)
            between = (b.word - p.word - p.size) - (b.place - p.place - p.size)
            if p.word < b.word and p.place < b.place and over < b.size and between <= gap and best[i] + b.size - over > score:
                score, back, gain = best[i] + b.size - over, i, b.size - over
        best.append(score), before.append(back), added.append(gain)
    at, chain = int(np.argmax(best)), []
    while at != -1:
        chain.append((found[at], added[at]))
        at = before[at]
    return chain[::-1]


def spans_of(template: int, size: int, found: list[Anchor], gap: int) -> list[Span]:
    """Chains of one template's anchors, apart from one another in the document: whole occurrences first, then the
    best chain of each stretch of anchors and what is left on its two sides."""
    found = sorted(found)
    out = [Span(template, f.word, f.word + size - 1, size) for f in found if f.size == size]
    starts = np.array([s.first_word for s in out])

    def free(f: Anchor) -> bool:
        k = np.searchsorted(starts, f.word, side="right") if len(starts) else 0
        return not ((k and f.word < starts[k - 1] + size) or (k < len(starts) and f.word + f.size > starts[k]))

    rest = [f for f in found if f.size < size and free(f)]
    stack, run, end = [], [], 0
    for f in rest:
        if run and end + size + gap < f.word:
            stack.append(run)
            run = []
        run.append(f)
        end = max(end, f.word + f.size)
    stack += [run] if run else []
    while stack:
        run = stack.pop()
        chain = best_chain(run, size, gap)
        first, last = chain[0][0].word, max(f.word + f.size for f, _ in chain)
        out.append(Span(template, first, last - 1, sum(n for _, n in chain)))
        stack += [part for part in ([f for f in run if f.word + f.size <= first], [f for f in run if f.word >= last]) if part]
    return sorted(out)


class Scanner:
    """Finds spans in the texts of Arrow columns with one automaton."""

    def __init__(self, a: Automaton, long: int, gap: int):
        self.a, self.long, self.gap = a, long, gap
        known = list(a.vocabulary)
        data = np.frombuffer(b" ".join(known), np.uint8)
        end = np.cumsum([len(w) + 1 for w in known]) - 1 if known else np.zeros(0, np.int64)
        prints = word_hashes(data, end - np.array([len(w) for w in known], np.int64), end)
        self.order = np.argsort(prints)
        self.prints = prints[self.order]
        self.n = len(known)
        # neighbouring words of templates, and those of templates too short for an anchor of ``long`` words
        two = {c * self.n + d: a.step[first][d] for c, first in a.step[0].items() for d in a.step[first]}
        need = np.where(a.is_phrase, a.lengths, np.minimum(a.lengths, long))
        self.pairs = np.array(sorted(two), np.int64)
        self.short = np.array(sorted(p for p, s in two.items() if any(need[t] < long for t in a.ends[s])), np.int64)

    def stretches(self, w) -> Iterator[tuple[int, int]]:
        """Runs of words (first, end) that can hold a piece."""
        if len(w.hash) < 2 or not self.n:
            return
        at = np.searchsorted(self.prints, w.hash)
        at[at == self.n] = 0
        known = self.prints[at] == w.hash
        ids = np.where(known, self.order[at], -1)
        pair = np.where(known[:-1] & known[1:] & (w.doc[:-1] == w.doc[1:]), ids[:-1] * self.n + ids[1:], -1)
        hit, short = np.isin(pair, self.pairs), np.isin(pair, self.short)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        sums = np.concatenate(([0], np.cumsum(short)))
        keep = (end - begin >= self.long - 1) | (sums[end] > sums[begin])
        yield from zip(begin[keep].tolist(), (end[keep] + 1).tolist())

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, list[Span]]]:
        """(row, words, spans) of every text, in order."""
        a = self.a
        for piece in pieces(column):
            w = words(piece, _GAP_BYTE)
            counts = w.counts(piece.n_docs) if len(w.hash) else np.zeros(piece.n_docs, np.int64)
            begins = np.concatenate(([0], np.cumsum(counts)))
            found: dict[int, dict[int, list[Anchor]]] = {}
            for begin, end in self.stretches(w):
                doc = int(w.doc[begin])
                ids = [a.vocabulary.get(piece.data[s:e].tobytes().lower(), -1) for s, e in zip(w.start[begin:end], w.end[begin:end])]
                mine = found.setdefault(doc, {})
                for t, more in anchors(a, ids, begin - int(begins[doc]), self.long).items():
                    mine.setdefault(t, []).extend(more)
            for i in range(piece.n_docs):
                spans = [s for t, f in sorted(found.get(i, {}).items()) for s in spans_of(t, int(a.lengths[t]), f, self.gap)]
                yield piece.first + i, int(counts[i]), spans


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans array<struct<label string, template int, first_word long, last_word long, covered int, share double>>")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES,
         long: int = LONG, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans.

    Words are lower-cased (A-Z only) runs of digits, letters and anything beyond ASCII. ``n_base`` counts all
    places of all phrases, overlapping ones too, ``first_word`` and ``last_word`` are the least and largest word
    (from 0) where one starts, null without any. ``labels`` has the labels of the phrases and of all
    templates of which a span covers ``share``; ``spans`` lists every span with its template's number, also those
    below ``share``; ``score`` is the largest share (1 where a phrase stands, 0 without spans). Templates and
    phrases of fewer than two words are left out.

    Null and empty texts have no words, score 0 and no labels; very long texts are used whole; repeated rows and
    rows without doc_id give a row each; equally good chains: the one that ends first. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(build(templates, phrases))   # bounded by the templates
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()),
                                    ("last_word", pa.int64()), ("covered", pa.int32()), ("share", pa.float64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        scanner = Scanner(a, long, gap)
        for batch in batches:
            out = [[] for _ in names[1:]]
            for _, n_words, spans in scanner.scan(batch.column(1)):
                base = [s for s in spans if a.is_phrase[s.template]]
                rows = [(a.labels[s.template], s.template, s.first_word, s.last_word, s.covered,
                         s.covered / int(a.lengths[s.template])) for s in spans]
                base_labels = {a.labels[s.template] for s in base}
                values = (n_words, len(base), min((s.first_word for s in base), default=None),
                          max((s.first_word for s in base), default=None), ",".join(sorted(base_labels)),
                          ",".join(sorted(base_labels | {r[0] for r in rows if r[5] >= share})),
                          max((r[5] for r in rows), default=0.0),
                          [dict(zip(("label", "template", "first_word", "last_word", "covered", "share"), r)) for r in rows])
                for column, v in zip(out, values):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span_type]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(out, kinds)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, SCHEMA)


@query("op11_license_scan")
def op11_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("spans")
