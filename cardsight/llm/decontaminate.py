"""Benchmark decontamination by size-partitioned MinHash containment search (operator 1).

Which documents contain at least ``percent`` of the word shingles of a test item? A document
can be a thousand times longer than an item, so the Jaccard similarity of the two is tiny
and one MinHash signature for all sizes would miss it. Documents are therefore partitioned
by set size, and the signature grows with the partition: one permutation of 64-bit hashes is
cut into 2 ** b bins and the least hash of each bin is kept. A shared shingle is found if it
is the least of its bin on both sides; b is chosen for each pair of size classes so that an
item with the wanted share of its shingles in a document is missed with probability
``miss`` at most (at very small items all shingles are kept, which misses nothing).

Candidates are verified by exact containment of the shingle sets in the same task, which has
the whole document and the items at hand. Items are broadcast in slices of at most ``SLICE``
shingles; a larger benchmark takes one pass over the documents for each slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table
from .text import U64, by_document, distinct, pieces, shingles, words

PERCENT = 80
MISS = 1e-9
SLICE = 2_000_000


class Items(NamedTuple):
    ids: np.ndarray
    sets: list[np.ndarray]          # sorted shingles of each item
    signatures: dict                # (item class, bins) -> (sorted least hashes, their items)
    classes: dict                   # item class -> smallest set size in it


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) for every row of a text column."""
    for p in pieces(column):
        h, doc = shingles(words(p), p.n_docs)
        for i, v in by_document(h, doc, p.n_docs):
            yield p.first + i, distinct(v)


def least(sorted_hashes: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of every bin that has one (the top ``bins`` bits are the bin)."""
    if bins >= 64 or len(sorted_hashes) < 2:
        return sorted_hashes
    which = sorted_hashes >> U64(64 - bins) if bins else np.zeros(len(sorted_hashes), np.uint64)
    return sorted_hashes[np.concatenate(([True], which[1:] != which[:-1]))]


def bins_for(size_class: int, smallest_item: int, percent: int, miss: float) -> int:
    """Bits of the bin number for documents of up to 2 ** size_class shingles; 64 keeps all."""
    shared = max(1, -(-percent * smallest_item // 100))
    need = 1 - miss ** (1 / shared)             # chance that a shared shingle is the least of its bin
    # with load x = shingles / bins it is about (1 - exp(-x)) / x; the item's own load is added
    for b in range(0, 40):
        load = (2.0 ** size_class + 2 * smallest_item) / 2.0 ** b
        if -math.expm1(-load) / load >= need:
            return b if b <= size_class + 3 else 64
    return 64


def prepare(ids: list[int], sets: list[np.ndarray]) -> Items:
    has = [i for i, s in enumerate(sets) if len(s)]
    classes: dict[int, int] = {}
    for i in has:
        c = (len(sets[i]) - 1).bit_length()
        classes[c] = min(classes.get(c, len(sets[i])), len(sets[i]))
    return Items(np.array(ids, np.int64), sets, {}, classes)


def signature(items: Items, item_class: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    key = (item_class, bins)
    if key not in items.signatures:
        own = [i for i, s in enumerate(items.sets) if len(s) and (len(s) - 1).bit_length() == item_class]
        hashes = [least(items.sets[i], bins) for i in own]
        h = np.concatenate(hashes)
        who = np.repeat(own, [len(x) for x in hashes])
        order = np.argsort(h, kind="stable")
        items.signatures[key] = h[order], who[order]
    return items.signatures[key]


def contained(doc: np.ndarray, items: Items, percent: int, miss: float) -> list[tuple[int, int]]:
    """(item, shared shingles) of the items that a document contains."""
    if not len(doc):
        return []
    found: set[int] = set()
    size_class = (len(doc) - 1).bit_length()
    for c, smallest in items.classes.items():
        if 100 * len(doc) < percent * smallest:
            continue
        bins = bins_for(size_class, smallest, percent, miss)
        h, who = signature(items, c, bins)
        mine = least(doc, bins)
        if len(h) < len(mine):  # look up the shorter list in the longer one
            at = np.searchsorted(mine, h)
            at[at == len(mine)] = 0
            found.update(who[mine[at] == h].tolist())
        else:
            a, z = np.searchsorted(h, mine, side="left"), np.searchsorted(h, mine, side="right")
            for x, y in zip(a[z > a], z[z > a]):
                found.update(who[x:y].tolist())
    out = []
    for i in sorted(found):
        item = items.sets[i]
        at = np.searchsorted(doc, item)
        at[at == len(doc)] = 0
        both = int((doc[at] == item).sum())
        if 100 * both >= percent * len(item):
            out.append((i, both))
    return out


def item_slices(benchmark: DataFrame, size: int = SLICE) -> Iterator[Items]:
    """The test items with their shingles, in slices of bounded size."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null") \
        .dropDuplicates(["item_id", "text"])
    n_bytes = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = max(1, -(-n_bytes // (2 * size)))   # a shingle starts with a word: two bytes at least
    for k in range(n_slices):
        part = known if n_slices == 1 else known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == k)
        rows = sorted(part.collect(), key=lambda r: (r.item_id, r.text or ""))
        sets = [s for _, s in shingle_sets(pa.array([r.text for r in rows], pa.string()))]
        yield prepare([r.item_id for r in rows], sets)


def search(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, miss: float = MISS, slice_size: int = SLICE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): the documents with ``percent`` of an item's shingles.

    An item of one to four words has its word sequence as one shingle; items without words or
    id match nothing; items of one id with different texts are items of their own. Null and
    empty documents contain nothing, very long ones are used whole, repeated rows give
    repeated pairs; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shared long, n_item long"
    out = spark.createDataFrame([], schema)
    for n, items in enumerate(item_slices(benchmark, slice_size)):
        shared = spark.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                hits = [(row, i, both) for row, s in shingle_sets(batch.column(1))
                        for i, both in contained(s, shared.value, percent, miss)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([h[0] for h in hits], pa.int64())),
                     pa.array([int(shared.value.ids[h[1]]) for h in hits], pa.int64()),
                     pa.array([h[2] for h in hits], pa.int64()),
                     pa.array([len(shared.value.sets[h[1]]) for h in hits], pa.int64())],
                    names=["doc_id", "item_id", "n_shared", "n_item"])

        pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema)
        out = pairs if n == 0 else out.unionByName(pairs)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, miss: float = MISS, slice_size: int = SLICE) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for items in item_slices(benchmark, slice_size):
        shared = spark.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = [not contained(s, shared.value, percent, miss) for _, s in shingle_sets(batch.column(at))]
                yield batch.filter(pa.array(mask, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


_SQL = """
with w as (select 'd' as kind, doc_id as id, regexp_extract_all(translate(text,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
           union all
           select 'b', item_id, regexp_extract_all(translate(text,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') from benchmark),
s as (select distinct kind, id, unnest(case when len(w) >= 5
        then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select id, count(*) as n_item from s where kind = 'b' group by id),
p as (select d.id as doc_id, b.id as item_id, count(*) as n_shared from s d join s b on d.g = b.g
      where d.kind = 'd' and b.kind = 'b' group by 1, 2)
select doc_id, item_id, n_shared, n_item from p join n on p.item_id = n.id where 100 * n_shared >= 80 * n_item
"""


@query("op1_decontaminate", _SQL)
def op1_decontaminate(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
