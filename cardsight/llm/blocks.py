"""Corpus blocks and fingerprint exchange: how operators compare all texts without moving them twice.

A block is a run of documents in order of doc_id with about ``BLOCK`` bytes of text, packed and
compressed as one row of a bucketed table in the shared folder; block numbers rise with doc_id,
so "in an earlier block" means "in a document with a smaller id". Blocks send sorted distinct
64-bit fingerprints to buckets (ranges of fingerprints); a bucket sorts what all blocks
sent it, one bucket at a time, and answers with one bit for each fingerprint. Blocks make
their fingerprints again from the text to read the answer, so neither ids nor positions travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folder, partitions, release
from .text import U64, Piece, string_buffer

BLOCK = 2 << 20
BUCKET = 3 << 20          # fingerprints that one bucket should get
MOST_BUCKETS = 1 << 16
NO_ID = np.iinfo(np.int64).max
SCHEMA = "block long, ids binary, sizes binary, shas binary, extra binary, body binary"


def compress(body: bytes) -> bytes:
    return pa.compress(body, codec="zstd", asbytes=True)


class Block(NamedTuple):
    block: int
    ids: np.ndarray       # doc_id of each document, rising; NO_ID stands for null and comes last
    offsets: np.ndarray
    data: np.ndarray
    shas: bytes           # sha256 of each text, 32 bytes each
    extra: bytes          # the other columns that were asked to be kept, as an Arrow stream

    @property
    def piece(self) -> Piece:
        return Piece(0, self.data, self.offsets)


def unpack(row: dict) -> Block:
    sizes = np.frombuffer(row["sizes"], np.int64)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    n = int(offsets[-1])
    data = np.frombuffer(pa.decompress(row["body"], n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return Block(row["block"], np.frombuffer(row["ids"], np.int64), offsets, data, row["shas"], row["extra"])


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    names = batch.schema.names
    columns = [batch.column(i) for i in range(len(names))]
    for i in range(batch.num_rows):
        yield {n: c[i].as_py() for n, c in zip(names, columns)}


def write_blocks(docs: DataFrame, keep: tuple[str, ...] = (), size: int = BLOCK) -> DataFrame:
    """Blocks of all documents (doc_id, text, and the columns to keep) in order of doc_id, then text.
    Rows of one doc_id stay in one block."""
    import hashlib

    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("__block_id"), F.col("text").alias("__block_text"), *keep)
    total = narrow.agg(F.sum(F.octet_length("__block_text"))).first()[0] or 0
    order = [F.col("__block_id").asc_nulls_last(), F.col("__block_text").asc_nulls_first()]
    ordered = narrow.repartitionByRange(partitions(spark, total, 8 * size), order[0]).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        weight, last = 0, None

        def row():
            texts = [t for _, ts, _ in held for t in ts]
            rest = b""
            if keep:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0][2].schema) as out:
                    for _, _, part in held:
                        out.write_batch(part)
                rest = compress(sink.getvalue().to_pybytes()) + len(sink.getvalue()).to_bytes(8, "little")
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([np.concatenate([i for i, _, _ in held]).tobytes()], pa.binary()),
                 pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
                 pa.array([b"".join(hashlib.sha256(t).digest() for t in texts)], pa.binary()),
                 pa.array([rest], pa.binary()), pa.array([compress(b"".join(texts))], pa.binary())],
                names=["block", "ids", "sizes", "shas", "extra", "body"])

        for batch in batches:
            own = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            data, offsets = string_buffer(batch.column(1))
            rest = batch.select(list(keep))
            a = 0
            while a < len(own):
                if weight >= size and own[a] != last:
                    yield row()
                    number, held, weight = number + 1, [], 0
                # as many rows as fill the block, and the rest of the last one's doc_id
                z = int(np.searchsorted(offsets, offsets[a] + max(size - weight, 1), side="left"))
                z = min(max(z, a + 1), len(own))
                z = max(z, int(np.searchsorted(own, own[z - 1], side="right")))
                held.append((own[a:z], [data[x:y].tobytes() for x, y in zip(offsets[a:z], offsets[a + 1:z + 1])], rest.slice(a, z - a)))
                weight += int(offsets[z] - offsets[a]) + 64 * (z - a)
                last, a = own[z - 1], z
        if held:
            yield row()

    # Bucketed by block, so that notes come to the blocks and the texts are not shuffled again.
    # Spark refuses more than 100,000 buckets; beyond a terabyte a bucket holds more blocks instead.
    path = folder(spark, "blocks")
    name = "cardsight_" + path.rsplit("/", 1)[1].replace("-", "_")
    ordered.mapInArrow(pack, SCHEMA).write.option("compression", "uncompressed").option("path", path) \
        .bucketBy(min(partitions(spark, total, 8 * size), MOST_BUCKETS), "block").sortBy("block").saveAsTable(name)
    release(spark)
    blocks = spark.table(name)
    blocks.text_bytes = total
    return blocks


def kept_columns(b: Block) -> pa.Table:
    """The other columns of a block's documents."""
    body, n = b.extra[:-8], int.from_bytes(b.extra[-8:], "little")
    return pa.ipc.open_stream(pa.decompress(body, n, codec="zstd")).read_all()


def rest_of(docs: DataFrame) -> tuple[str, ...]:
    """All columns besides doc_id and text."""
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def kept_schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    """Schema of :func:`documents_of`, without text."""
    types = dict(docs.dtypes)
    return "doc_id long" + "".join(f", `{c}` {types[c]}" for c in keep)


def documents_of(b: Block, keep: tuple[str, ...]) -> dict[str, pa.Array]:
    """doc_id and the kept columns of a block's documents."""
    columns = {"doc_id": pa.array(b.ids, pa.int64(), mask=b.ids == NO_ID)}
    if keep:
        table = kept_columns(b)
        columns |= {c: table.column(c).combine_chunks() for c in keep}
    return columns


def text_bytes(blocks: DataFrame) -> int:
    return int(blocks.text_bytes)


def buckets_for(n_fingerprints: float, each: int = BUCKET) -> int:
    """A power of two, so that a bucket is the top bits of the fingerprint."""
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n_fingerprints / each)))))


def bucket_bounds(sorted_fps: np.ndarray, n_buckets: int) -> np.ndarray:
    if n_buckets == 1:
        return np.array([0, len(sorted_fps)])
    step = U64(64 - int(np.log2(n_buckets)))
    return np.concatenate((np.searchsorted(sorted_fps, np.arange(n_buckets, dtype=np.uint64) << step), [len(sorted_fps)]))


def shortened(values: np.ndarray, bucket_bits: int, n_bytes: int) -> bytes:
    """The first ``n_bytes`` of each value after the bits that name its bucket, in the same order."""
    if n_bytes == 8:
        return values.tobytes()
    rest = values << U64(bucket_bits) if bucket_bits else values
    return rest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].tobytes()


def lengthened(sent: bytes, n_bytes: int) -> np.ndarray:
    if n_bytes == 8:
        return np.frombuffer(sent, np.uint64)
    short = np.frombuffer(sent, np.uint8).reshape(-1, n_bytes)
    full = np.zeros((len(short), 8), np.uint8)
    full[:, :n_bytes] = short
    return full.view(">u8").ravel().astype(np.uint64)


# Enough bytes where a wrong "another block has it" only costs work: with ``BUCKET`` values in
# a bucket, at any corpus size, three in a million are taken for shared.
HINT_BYTES = 5
SENT = "bucket int, block long, fps binary"
ANSWER = "block long, bucket int, bits binary"


def send(block: int, sorted_fps: np.ndarray, n_buckets: int, turn: int = 0, turns: int = 1, n_bytes: int = 8) -> pa.RecordBatch:
    """One row for each bucket; with several turns, only for the buckets of this turn."""
    bits = int(np.log2(n_buckets))
    at = bucket_bounds(sorted_fps, n_buckets)
    full = np.flatnonzero(np.diff(at))
    full = full[full % turns == turn]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array(np.full(len(full), block), pa.int64()),
         pa.array([shortened(sorted_fps[at[b]:at[b + 1]], bits, n_bytes) for b in full], pa.binary())],
        names=["bucket", "block", "fps"])


def answered(group: pa.Table, earlier: bool, n_bytes: int = 8) -> pa.Table:
    """The answers to one bucket: see :func:`answer`."""
    block = group.column("block").to_numpy()
    rows = np.argsort(block, kind="stable")
    fps = [lengthened(group.column("fps")[int(r)].as_py(), n_bytes) for r in rows]
    sizes = np.array([len(f) for f in fps])
    values = np.concatenate(fps)
    order = np.argsort(values, kind="stable")      # ties stay in order of blocks
    values = values[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    if earlier:
        hit = ~new
    else:
        hit = ~new | ~np.concatenate((new[1:], [True]))
    bits = np.empty(len(order), bool)
    bits[order] = hit
    cut = np.concatenate(([0], np.cumsum(sizes)))
    return pa.table({"block": pa.array(block[rows], pa.int64()),
                     "bucket": pa.array(np.full(len(rows), group.column("bucket")[0].as_py()), pa.int32()),
                     "bits": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})


def answer(sent: DataFrame, earlier: bool, n_bytes: int = 8) -> DataFrame:
    """For each fingerprint that a block sent: does another block have it (``earlier``: a block
    before this one)? One sorted bucket at a time; a fingerprint that every block has counts
    one entry a block."""
    return sent.groupBy("bucket").applyInArrow(lambda group: answered(group, earlier, n_bytes), ANSWER)


def read_answer(answers: list[tuple[int, bytes]], sorted_fps: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bits of one block's sorted fingerprints."""
    at = bucket_bounds(sorted_fps, n_buckets)
    out = np.zeros(len(sorted_fps), bool)
    for bucket, bits in answers:
        a, b = at[bucket], at[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def with_notes(blocks: DataFrame, notes: DataFrame, fn: Callable, schema: str, noted_only: bool = False) -> DataFrame:
    """``fn(Block, notes of this block)`` for each block (``noted_only``: each that has notes); ``notes`` has
    (block, kind, bucket, bits). Yields record batches that are put together into the result."""
    target = None

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in rows_of(left) if right.num_rows or not noted_only else ():
            noted = [(r["kind"], r["bucket"], r["bits"]) for r in rows_of(right)]
            out.extend(fn(unpack(row), noted))
        return pa.Table.from_batches(out) if out else target_table()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))

    def target_table():
        return target.empty_table()

    return blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(both, schema)
