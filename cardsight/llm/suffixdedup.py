"""Removal of repeated 50-byte strings by difference-cover blockwise suffix sorting (operator 2).

Every byte position of a text starts a suffix; two suffixes match if their first ``width``
bytes are equal. Sorting all suffixes at once would need many times the text in memory and
on disk, so it is done in blocks of the order and only for suffixes that can match:

1. Cover samples. ``COVER`` is a difference cover modulo ``PERIOD``: for any two positions
   there is one shift below ``PERIOD`` that brings both to sampled positions. If two suffixes
   match on ``width`` bytes, the blocks of ``width - PERIOD + 1`` bytes at that shift are
   sampled in both documents and equal. All sampled blocks are ranked, one bucket of their
   order at a time, which tells for each sample whether its rank is shared.
2. A suffix with no shared rank among its cover samples ties with no other, and is dropped.
   The rest are sorted one bucket at a time; ties are resolved by depth-``width`` names, and
   the answer for a suffix is whether an equal one starts in an earlier document.
3. Bytes covered by suffixes with an earlier match are removed.

Memory holds one bucket (``blocks.BUCKET`` suffixes) or one block of text. Suffixes are
named by 64-bit fingerprints of exactly ``width`` bytes; among n different strings the chance
of one wrong match is about n * n / 2 ** 65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (HINT_BYTES, NO_ID, SENT, Block, answer, buckets_for, read_answer, rows_of, send, text_bytes, unpack,
                     with_notes, write_blocks)
from .common import query, stored, table
from .text import U64, Prints, distinct

WIDTH = 50
PERIOD = 31
TURNS = 3    # the buckets of suffixes are sorted in so many turns, which bounds the disk in use
COVER = (0, 1, 3, 8, 12, 18)  # every residue modulo 31 is a difference of two of these

_VALUE = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def prints_of(b: Block) -> Prints:
    return Prints(b.data, _VALUE)


def cover_samples(b: Block, width: int) -> np.ndarray:
    """Sampled positions, counted from the start of their document."""
    size = width - PERIOD + 1
    out = []
    for a, z in zip(b.offsets, b.offsets[1:]):
        if z - a >= width:
            grid = np.arange(a, z - size + 1, PERIOD)[:, None] + np.array(COVER)
            out.append(grid[grid <= z - size])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def doc_of(b: Block, position: np.ndarray) -> np.ndarray:
    return np.searchsorted(b.offsets, position, side="right") - 1


def named(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct fingerprints, index of each into them)."""
    order = np.argsort(fps)     # the order of equal ones does not show
    values = fps[order]
    new = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    index = np.empty(len(fps), np.int64)
    index[order] = np.cumsum(new) - 1
    return values[new], index


def active_suffixes(b: Block, prints: Prints, notes: list, n_buckets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes to sort, and which documents are later copies of a whole text."""
    copies = np.zeros(len(b.ids), bool)
    for kind, _, bits in notes:
        if kind == "copy":
            copies[np.frombuffer(bits, np.int64)] = True
    at = cover_samples(b, width)
    if not len(at):
        return at, copies
    names, index = named(prints.at(at, at + width - PERIOD + 1))
    shared = read_answer([(k, x) for kind, k, x in notes if kind == "rank"], names, n_buckets)[index]
    ids = b.ids[doc_of(b, at)]
    low, high = np.full(len(names), NO_ID), np.full(len(names), np.iinfo(np.int64).min)
    np.minimum.at(low, index, ids)
    np.maximum.at(high, index, ids)
    shared |= (low < high)[index]
    hits = np.zeros(len(b.data) + 1, np.int32)
    marks = np.zeros(len(b.data), np.int32)
    marks[at[shared]] = 1
    np.cumsum(marks, out=hits[1:])
    start = np.arange(len(b.data) - width + 1) if len(b.data) >= width else np.zeros(0, np.int64)
    start = start[hits[start + PERIOD] > hits[start]]
    doc = doc_of(b, start)
    return start[(start + width <= b.offsets[doc + 1]) & ~copies[doc]], copies


def later_copies(blocks: DataFrame, width: int) -> DataFrame:
    """Notes naming the documents whose whole text is that of a document with a smaller id."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                ids, sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64)
                has = np.flatnonzero(sizes >= width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shas"][32 * i:32 * i + 32] for i in has], pa.binary()),
                     pa.array(np.full(len(has), r["block"]), pa.int64()), pa.array(has, pa.int64()),
                     pa.array(ids[has], pa.int64())], names=["sha", "block", "nth", "id"])

    docs = blocks.select("block", "ids", "sizes", "shas").mapInArrow(explode, "sha binary, block long, nth long, id long")
    first = docs.groupBy(F.col("sha").alias("_sha")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")) \
        .filter("n > 1").drop("n")
    copies = docs.join(first, F.col("sha") == F.col("_sha")).filter("id > first").select("block", "nth")

    def note(group: pa.Table) -> pa.Table:
        nth = group.column("nth").to_numpy()
        return pa.table({"block": group.column("block")[:1], "kind": pa.array(["copy"]), "bucket": pa.array([0], pa.int32()),
                         "bits": pa.array([nth.astype(np.int64).tobytes()], pa.binary())})

    return copies.groupBy("block").applyInArrow(note, "block long, kind string, bucket int, bits binary")


def as_notes(answers: DataFrame, kind: str) -> DataFrame:
    return answers.select("block", F.lit(kind).alias("kind"), "bucket", "bits")


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """Texts without the bytes of any ``width``-byte string that a document with a smaller id has.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if
    asked, kept (binary: a cut may fall inside a character). Matches never cross documents and
    are judged on the input. Null texts are empty, short and empty texts stay as they are;
    a null doc_id comes after all others; rows of one doc_id do not remove one another; an
    empty table gives no rows; other columns are ignored.
    """
    if width < PERIOD + 4:
        raise ValueError(f"width must be at least {PERIOD + 4}")
    blocks = write_blocks(docs)
    n_text = text_bytes(blocks)
    rank_buckets = buckets_for(n_text * len(COVER) / PERIOD)
    suffix_buckets = max(4, buckets_for(n_text * 0.2))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                b = unpack(r)
                at = cover_samples(b, width)
                if len(at):
                    yield send(b.block, distinct(prints_of(b).at(at, at + width - PERIOD + 1)), rank_buckets, n_bytes=HINT_BYTES)

    ranks = stored(as_notes(answer(blocks.mapInArrow(sample, SENT), False, HINT_BYTES), "rank"), "ranks")
    ranks = stored(ranks.unionByName(later_copies(blocks, width)), "notes")

    def suffixes(turn: int):
        def of(b: Block, notes: list) -> Iterator[pa.RecordBatch]:
            prints = prints_of(b)
            start, _ = active_suffixes(b, prints, notes, rank_buckets, width)
            if len(start):
                yield send(b.block, distinct(prints.at(start, start + width)), suffix_buckets, turn, TURNS)
        return of

    found = ranks.limit(0)
    for turn in range(TURNS):  # each turn's suffixes are gone from disk before the next one's are sent
        sent = with_notes(blocks, ranks, suffixes(turn), SENT)
        found = found.unionByName(stored(as_notes(answer(sent, earlier=True), "earlier"), "earlier"))

    def cut(b: Block, notes: list) -> Iterator[pa.RecordBatch]:
        prints = prints_of(b)
        start, copies = active_suffixes(b, prints, notes, rank_buckets, width)
        gone = np.zeros(len(b.data) + 1, np.int32)
        if len(start):
            names, index = named(prints.at(start, start + width))
            before = read_answer([(k, x) for kind, k, x in notes if kind == "earlier"], names, suffix_buckets)[index]
            ids = b.ids[doc_of(b, start)]
            low = np.full(len(names), NO_ID)
            np.minimum.at(low, index, ids)
            hit = start[before | (ids > low[index])]
            gone[hit] += 1
            np.subtract.at(gone, hit + width, 1)
        covered = np.cumsum(gone[:-1]) > 0
        for i in np.flatnonzero(copies):
            covered[b.offsets[i]:b.offsets[i + 1]] = True
        rows = []
        for i, (a, z) in enumerate(zip(b.offsets, b.offsets[1:])):
            c, text = covered[a:z], b.data[a:z]
            n = int(c.sum())
            kept = text.tobytes() if not n else text[~c].tobytes()
            spans = int(np.count_nonzero(c[1:] & ~c[:-1])) + int(n > 0 and bool(c[0]))
            rows.append((None if b.ids[i] == NO_ID else int(b.ids[i]), int(z - a), n, spans,
                         hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names_out)

    names_out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return with_notes(blocks, ranks.unionByName(found), cut, schema)


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


