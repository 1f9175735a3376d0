"""Bounded labelled samples for the classifiers, and scoring of all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Piece, pieces


def held_out(mod: int, rest: int, column: str = "doc_id"):
    """crc32 of doc_id as text, modulo ``mod``, is ``rest`` (a null id is not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(mod)) == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int) -> DataFrame:
    """At most ``per_class`` documents of each label that ``learn`` allows, picked by a hash of
    doc_id: text, y (0 or 1), weight (documents of the label for each one picked).

    A label that is null or has no doc_id is left out; several labels of a document count
    as 1 if at least half of them are."""
    one = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    one = one.filter(learn).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    # each task keeps its own first rows, so no task sees all rows of a label
    first = [one.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = first[0].unionAll(first[1])
    sizes = one.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    picked = picked.join(F.broadcast(sizes), "y") \
        .select(F.col("doc_id").alias("_id"), "y", (F.greatest(F.col("n") / per_class, F.lit(1.0))).alias("weight"))
    # at most 2 * per_class rows: a bound set by parameter
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")) \
        .select("text", "y", "weight")


def sparse_sample(sampled: DataFrame, terms: Callable[[Piece], tuple], bits: int) -> dict[str, np.ndarray]:
    """The bounded sample as sparse rows on the driver: y, weight, bounds, slot, count."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, weight = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for p in pieces(batch.column(0)):
                bounds, slot, n = terms(p, bits)
                slot, n = slot.astype(np.int32), n.astype(np.int32)
                cells = [(slot[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                at = slice(p.first, p.first + p.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[at], pa.int32()), pa.array(weight[at], pa.float64()),
                     pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())],
                    names=["y", "weight", "slot", "n"])

    got = sampled.mapInArrow(rows, "y int, weight double, slot binary, n binary").collect()
    got.sort(key=lambda r: (r.y, bytes(r.slot), bytes(r.n)))  # the fit does not depend on task order
    slots = [np.frombuffer(r.slot, np.int32) for r in got]
    empty = [np.zeros(0, np.int32)]
    return {"y": np.array([r.y for r in got], np.float32), "weight": np.array([r.weight for r in got], np.float32),
            "bounds": np.concatenate(([0], np.cumsum([len(s) for s in slots], dtype=np.int64))).astype(np.int64),
            "slot": np.concatenate(slots + empty), "n": np.concatenate([np.frombuffer(r.n, np.int32) for r in got] + empty)}


def score_documents(docs: DataFrame, score: Callable[[Piece], np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row; ``score`` gets whole documents of about two megabytes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [score(p) for p in pieces(batch.column(1))]
            values = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, score double")
