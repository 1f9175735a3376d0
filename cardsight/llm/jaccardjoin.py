"""N-gram Jaccard join as a blocked sparse matrix product (operator 3).

Documents are rows and word shingles are columns of a 0/1 matrix A; the overlap counts are
the entries of A times its transpose. Only entries with 100 * overlap >= ``percent`` * union
are wanted, so work that the sizes rule out is never done:

1. Columns of one document add nothing to any product. Blocks of columns (``blocks.answer``)
   tell which shingles are shared, and a document with fewer than ``percent`` of its shingles
   shared can have no link: rows are discarded before any product.
2. The remaining matrix is counted again by blocks of columns. Each row's columns are ordered
   by rarity and all but a prefix can be ignored for finding pairs: two rows that link share
   a column of both prefixes. Products of the prefix columns give the candidate pairs, with
   their overlap so far, and pairs below the bound given by their sizes are discarded.
3. Overlaps of the pairs left are completed over all columns.

A group of thousands of near copies is not expanded into all pairs: prefix columns are first
multiplied with one row each (a star), links found there are merged into components, and
products between two rows are taken only where their components still differ. No link between
different components is lost, so components are exact.

Shingles are 64-bit hashes of five words; equal sets are one row (named by the first 64 bits
of a sha256 of the set).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import (HINT_BYTES, NO_ID, SENT, Block, answer, bucket_bounds, buckets_for, documents_of, kept_schema,
                     read_answer, rest_of, send, text_bytes, with_notes, write_blocks)
from .common import finished, query, stored, table
from .components import components
from .suffixdedup import as_notes, later_copies, named
from .text import by_document, distinct, shingles, words

PERCENT = 80


def sets_of(b: Block) -> list[np.ndarray]:
    """The shingle set of each document, sorted."""
    p = b.piece
    h, doc = shingles(words(p), p.n_docs)
    return [distinct(v) for _, v in by_document(h, doc, p.n_docs)]


def copied(b: Block, notes: list) -> np.ndarray:
    out = np.zeros(len(b.ids), bool)
    for kind, _, bits in notes:
        if kind == "copy":
            out[np.frombuffer(bits, np.int64)] = True
    return out


def node_of(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.sha256(values.tobytes()).digest()[:8], "little", signed=True)


def incidence(blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row a document: block and nth place in it, id, n (set size), node (name of the set; null if
    empty) and, where a link is possible and for one of several equal texts, the sorted shared shingles."""
    n_buckets = buckets_for(text_bytes(blocks) / 6)
    copies = stored(later_copies(blocks, 1), "copies")

    def columns(b: Block, notes: list) -> Iterator[pa.RecordBatch]:
        skip = copied(b, notes)
        own = [s for s, c in zip(sets_of(b), skip) if not c and len(s)]
        if own:
            yield send(b.block, distinct(np.concatenate(own)), n_buckets, n_bytes=HINT_BYTES)

    shared = stored(as_notes(answer(with_notes(blocks, copies, columns, SENT), False, HINT_BYTES), "shared"), "shared")

    def rows(b: Block, notes: list) -> Iterator[pa.RecordBatch]:
        skip = copied(b, notes)
        sets = sets_of(b)
        own = [s for s, c in zip(sets, skip) if not c and len(s)]
        blobs: list[bytes | None] = [None] * len(sets)
        if own:
            every = np.concatenate(own)
            names, index = named(every)
            hit = read_answer([(k, x) for kind, k, x in notes if kind == "shared"], names, n_buckets)
            # one document more in this block; equal sets count as one row
            kinds = {node_of(s): i for i, s in enumerate(own)}
            once = np.concatenate([named_in(names, own[i]) for i in kinds.values()])
            hit = (hit | (np.bincount(once, minlength=len(names)) > 1))[index]
            at = 0
            for i, (s, c) in enumerate(zip(sets, skip)):
                if not c and len(s):
                    keep = hit[at:at + len(s)]
                    at += len(s)
                    if 100 * int(keep.sum()) >= percent * len(s):
                        blobs[i] = s[keep].tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(sets), b.block), pa.int64()), pa.array(range(len(sets)), pa.int64()),
             pa.array(b.ids, pa.int64(), mask=b.ids == NO_ID), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
             pa.array(blobs, pa.binary())], names=["block", "nth", "doc_id", "n", "node", "shared"])

    schema = "block long, nth long, doc_id long, n long, node long, shared binary"
    return with_notes(blocks, copies.unionByName(shared), rows, schema)


def named_in(names: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted(names, values)


def prefixes(rows: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """(col, node, n, m, width, rest, weight): the columns of each row that can begin a link, rarest
    first. The row has n columns, m of them shared, ``width`` in the prefix and ``rest`` shared ones
    from this one on; ``weight`` is the mean count of its columns, highest for the centre of a
    group of near copies. ``rows``: node, n, shared, one for each node."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for i, blob in enumerate(batch.column(2)):
                v = np.frombuffer(blob.as_py(), np.uint64)
                at = bucket_bounds(v, n_buckets)
                out += [(k, int(node[i]), int(n[i]), v[at[k]:at[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(at))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                zip(*out) if out else [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "node", "n", "part"])

    def count(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("part")]
        names, index = named(np.concatenate(parts))
        many = np.bincount(index)[index]
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        kept = [(p[many[a:b] > 1].tobytes(), many[a:b][many[a:b] > 1].astype(np.int64).tobytes())
                for p, a, b in zip(parts, at, at[1:])]
        return pa.table({"node": group.column("node"), "n": group.column("n"), "part": pa.array([k[0] for k in kept], pa.binary()),
                         "many": pa.array([k[1] for k in kept], pa.binary())})

    def order(group: pa.Table) -> pa.Table:
        node, n = group.column("node")[0].as_py(), group.column("n")[0].as_py()
        v = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column("part")])
        many = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("many")])
        width = max(0, len(v) - -(-percent * n // 100) + 1)
        m, weight = len(v), float(many.sum()) / n
        v = v[np.lexsort((v, many))][:width]
        same = lambda x: pa.array(np.full(len(v), x))
        return pa.table({"col": pa.array(v.view(np.int64), pa.int64()), "node": same(node), "n": same(n), "m": same(m),
                         "width": same(width), "rest": pa.array(m - np.arange(len(v)), pa.int64()), "weight": same(weight)})

    parts = rows.select("node", "n", "shared").mapInArrow(cut, "bucket int, node long, n long, part binary")
    counted = parts.groupBy("bucket").applyInArrow(count, "node long, n long, part binary, many binary")
    return stored(counted.groupBy("node").applyInArrow(
        order, "col long, node long, n long, m long, width long, rest long, weight double"), "prefixes")


def linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap over all columns makes a link."""
    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            both = np.array([len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64),
                                                assume_unique=True)) for x, y in zip(batch.column(4), batch.column(5))], np.int64)
            ok = 100 * both >= percent * (na + nb - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok], pa.int64()), pa.array(b[ok], pa.int64())], names=["a", "b"])

    left = rows.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = rows.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb") \
        .mapInArrow(overlap, "a long, b long")


def roots(every: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the rows that have links: root names the component."""
    rows = stored(every.filter("shared is not null").dropDuplicates(["node"]).select("node", "n", "shared"), "matrix")
    n_cells = rows.agg(F.sum(F.octet_length("shared"))).first()[0] or 0
    cells = prefixes(rows, percent, buckets_for(n_cells / 8, 1 << 20))
    root = None
    links = None
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("nb")) / (100 + percent))
    # a pair has at most the smaller count of shared columns, and of those from the first common one on
    fits = (F.col("root") != F.col("rb")) & (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")) \
        & (F.least("m", "mb") >= need)
    early = F.least("rest", "restb") >= need
    other = [F.col("col").alias("_col"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"),
             F.col("width").alias("wb"), F.col("rest").alias("restb"), F.col("root").alias("rb")]
    for hub in (F.max(F.struct("weight", "node")), F.min(F.struct(F.lit(0.0).alias("weight"), "node")), None):
        own = cells.withColumn("root", F.col("node")) if root is None else \
            cells.join(root, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("root", F.coalesce("root", "node"))
        # only columns where components still differ
        split = own.groupBy(F.col("col").alias("_col")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")) \
            .filter("lo < hi").select("_col")
        own = own.join(split, F.col("col") == F.col("_col"), "left_semi")
        right = own.select(*other)
        if hub is not None:
            hubs = own.groupBy(F.col("col").alias("_h")).agg(hub.alias("hub")).select("_h", F.col("hub.node").alias("_b"))
            right = right.join(hubs, (F.col("_col") == F.col("_h")) & (F.col("b") == F.col("_b")), "left_semi")
            met = own.join(right, (F.col("col") == F.col("_col")) & fits & early).groupBy(F.col("node").alias("a"), "b").agg(
                F.count(F.lit(1)).alias("met"))
            best = Window.partitionBy("a").orderBy(F.desc("met"), "b")
            pairs = met.withColumn("nth", F.row_number().over(best)).filter("nth <= 2")
        else:
            # The first common column of two rows that link has all their common columns from it on, in
            # both rows, so it is early and in both prefixes: every pair that has such a column is verified.
            pairs = own.join(right, (F.col("col") == F.col("_col")) & (F.col("node") < F.col("b")) & fits & early) \
                .select(F.col("node").alias("a"), "b").distinct()
        found = stored(linked(pairs, rows, percent), "found")
        links = found if links is None else links.unionByName(found)
        root = stored(components(links).select(F.col("node").alias("_node"), "root"), "roots")
    return root


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components of documents linked by shingle sets with Jaccard of ``percent`` in 100 or more.

    Returns one row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable
    by links, itself included). A document of one to four words has its word sequence as one
    shingle; one without words (null, empty, blanks) has none and no link. Repeated rows and
    copies are linked; rows of one doc_id with different texts are documents of their own; a
    null doc_id counts as larger than any. An empty table gives no rows; very long texts are
    used whole; other columns are ignored.
    """
    spark = docs.sparkSession
    every = finished(spark, lambda: incidence(write_blocks(docs), percent), "incidence")
    root = finished(spark, lambda: roots(every, percent), "components")
    named_rows = every.select("doc_id", "n", "node")
    low = named_rows.filter("node is not null").groupBy(F.col("node").alias("_k")).agg(F.min("doc_id").alias("low"))
    low = low.join(root, F.col("_k") == F.col("_node"), "left").select("_k", "low", F.coalesce("root", "_k").alias("root"))
    least = low.groupBy(F.col("root").alias("_r")).agg(F.min("low").alias("component_id"))
    label = low.join(least, F.col("root") == F.col("_r")).select("_k", "component_id")
    return named_rows.join(label, F.col("node") == F.col("_k"), "left") \
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component left, the first by doc_id (null last); rows without
    words all stay. All columns are returned; see :func:`join` for what links."""
    keep = rest_of(docs)
    blocks = write_blocks(docs, keep)
    every = finished(docs.sparkSession, lambda: incidence(blocks, percent), "incidence")
    rows = every.filter("node is not null").select("block", "nth", "node")
    root = finished(docs.sparkSession, lambda: roots(every, percent), "components")
    rows = rows.join(root, F.col("node") == F.col("_node"), "left") \
        .select("block", "nth", F.coalesce("root", "node").alias("root"))
    first = rows.groupBy(F.col("root").alias("_r")).agg(F.min(F.struct("block", "nth")).alias("first"))
    gone = rows.join(first, F.col("root") == F.col("_r")) \
        .filter((F.col("block") != F.col("first.block")) | (F.col("nth") != F.col("first.nth"))).select("block", "nth")

    def note(group: pa.Table) -> pa.Table:
        return pa.table({"block": group.column("block")[:1], "kind": pa.array(["copy"]), "bucket": pa.array([0], pa.int32()),
                         "bits": pa.array([group.column("nth").to_numpy().astype(np.int64).tobytes()], pa.binary())})

    notes = gone.groupBy("block").applyInArrow(note, "block long, kind string, bucket int, bits binary")

    def left(b: Block, noted: list) -> Iterator[pa.RecordBatch]:
        texts = [b.data[x:y].tobytes() for x, y in zip(b.offsets, b.offsets[1:])]
        columns = documents_of(b, keep) | {"text": pa.array(texts, pa.binary()).cast(pa.string())}
        yield pa.RecordBatch.from_pydict(columns).filter(pa.array(~copied(b, noted)))

    out = with_notes(blocks, notes, left, kept_schema(docs, keep) + ", text string")
    return out.select(*docs.columns)


@query("op3_jaccard_join")
def op3_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
