"""Quality by nearest-neighbour voting in a latent-semantic space (operator 8).

Documents are vectors of hashed terms (bare words and word shapes, ``2 ** bits`` slots),
weighted by log count and the inverse document frequency over all documents, projected on
the main singular directions of a bounded labelled sample. The labelled vectors are
broadcast (``2 * per_class`` rows at any corpus size); every document is compared with all
of them by blocked matrix products, exactly, and its nearest neighbours vote with their
cosine as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import query, table
from .features import bare_words, shapes, term_counts
from .text import Piece, pieces

BITS = 12
RANK = 48
NEIGHBOURS = 25
PER_CLASS = 1536
CUT = 0.3
BLOCK = 512


def terms(piece: Piece, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bare words in the lower half of the slots, shapes in the upper half."""
    b1, s1, n1 = term_counts(*bare_words(piece), piece.n_docs, bits - 1)
    b2, s2, n2 = term_counts(*shapes(piece), piece.n_docs, bits - 1)
    doc = np.concatenate((np.repeat(np.arange(piece.n_docs), np.diff(b1)), np.repeat(np.arange(piece.n_docs), np.diff(b2))))
    order = np.argsort(doc, kind="stable")
    slot, n = np.concatenate((s1, s2 + (1 << (bits - 1))))[order], np.concatenate((n1, n2))[order]
    return b1 + b2, slot, n


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many documents each slot occurs, and the number of documents, over all rows.

    Each task sends one vector of ``2 ** bits`` counts for its whole partition; they are summed by
    part of the vector."""
    parts = 8
    width = (1 << bits) // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for p in pieces(batch.column(0)):
                _, slot, _ = terms(p, bits)
                total += np.bincount(slot, minlength=1 << bits)
                n += p.n_docs
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array([n] * parts, pa.int64()),
             pa.array(list(total.reshape(parts, width)), pa.list_(pa.int64()))], names=["part", "n", "counts"])

    sent = docs.select("text").mapInArrow(count, "part int, n long, counts array<long>")
    long = sent.select("part", "n", F.posexplode("counts").alias("i", "c"))
    df, n = np.zeros(1 << bits, np.int64), 0
    for r in long.groupBy("part", "i").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        df[r.part * width + r.i] = r.c
        n = r.n
    return df, n


class Model(NamedTuple):
    idf: np.ndarray      # slot
    project: np.ndarray  # slot x rank
    vectors: np.ndarray  # labelled sample x rank, unit length
    votes: np.ndarray    # label (0 or 1) of each
    weights: np.ndarray  # documents each one stands for, mean 1
    prior: float


def weigh(bounds: np.ndarray, slot: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Dense rows of unit length."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    x = np.zeros((len(bounds) - 1, len(idf)), np.float32)
    x[rows, slot] = (1 + np.log(n)) * idf[slot]
    return unit(x)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def directions(x: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """The main right singular vectors by subspace iteration, with signs and order fixed."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).normal(size=(x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", per_class: int = PER_CLASS,
        bits: int = BITS, rank: int = RANK) -> Model:
    df, n = document_frequencies(docs, bits)
    idf = np.log((n + 1.0) / (df + 1.0)).astype(np.float32) + 0.1
    sampled = labelled.sample(docs, labels, label, learn, per_class)
    data = labelled.sparse_sample(sampled, terms, bits)
    if not len(data["y"]):
        return Model(idf, np.zeros((len(idf), 1), np.float32), np.zeros((0, 1), np.float32),
                     np.zeros(0, np.float32), np.zeros(0, np.float32), 0.5)
    x = weigh(data["bounds"], data["slot"], data["n"], idf)
    project = directions(x, rank)
    weights = data["weight"] / data["weight"].mean()
    return Model(idf, project, unit(x @ project), data["y"], weights,
                 float(np.sum(weights * data["y"]) / np.sum(weights)))


def vote(vectors: np.ndarray, model: Model, k: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the k nearest labelled vectors, weighted by cosine; the share of
    the whole sample counts like one neighbour of cosine 0.02, so a far or empty text gets it."""
    near = vectors @ model.vectors.T
    k = min(k, near.shape[1])
    if not k:
        return np.full(len(vectors), model.prior)
    top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k:] if k < near.shape[1] \
        else np.tile(np.arange(k), (len(near), 1))
    sim = np.maximum(np.take_along_axis(near, top, 1), 0.0).astype(np.float64)
    w = sim * model.weights[top]
    return (np.sum(w * model.votes[top], 1) + 0.02 * model.prior) / (np.sum(w, 1) + 0.02)


def score(docs: DataFrame, model: Model, bits: int = BITS, k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score) of every row, repeated rows too. Null and empty texts get the share of
    label 1 in the sample; very long texts are read whole; an empty table gives no rows; other
    columns are ignored. Equally near neighbours at the k-th place are taken as they come."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(piece: Piece) -> np.ndarray:
        m = shared.value
        bounds, slot, n = terms(piece, bits)
        out = np.empty(piece.n_docs)
        for a in range(0, piece.n_docs, BLOCK):
            b = min(a + BLOCK, piece.n_docs)
            at = slice(bounds[a], bounds[b])
            x = weigh(bounds[a:b + 1] - bounds[a], slot[at], n[at], m.idf)
            out[a:b] = vote(unit(x @ m.project), m, k)
        return out

    return labelled.score_documents(docs, of)


@query("op8_quality")
def op8_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, ~labelled.held_out(5, 0))
    return score(docs, model).select("doc_id", labelled.held_out(5, 0).alias("held_out"), "score",
                                     (F.col("score") >= CUT).cast("int").alias("predicted"))
