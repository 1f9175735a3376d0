"""Toxicity by a factorization machine over hashed terms (operator 9).

A document is the set of its hashed bare words. The machine adds a weight for each term and
the product of two latent vectors for each pair of terms, so a pair such as an insult with
the mention of a group counts beyond what its words do alone. All pairs of a document cost
one pass over its terms: half of (sum of vectors) squared minus the sum of squares.

The fit is a weighted logistic loss by full-batch Adam on at most ``per_class`` labelled
documents of each label, put together on the driver (a bound set by parameter). Scoring runs
over all documents in Arrow batches; the broadcast model has ``2 ** bits`` rows at any size.
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
from .features import bare_words, term_counts
from .text import Piece, pieces

BITS = 18
FACTORS = 6
PER_CLASS = 4096
CUT = 0.3


class Model(NamedTuple):
    bias: float
    linear: np.ndarray   # slot -> weight
    factors: np.ndarray  # slot -> latent vector

    def logits(self, bounds: np.ndarray, slot: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        out = np.full(n, self.bias, np.float64)
        has = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(has):
            at = bounds[:-1][has]
            out[has] += np.add.reduceat(self.linear[slot], at, dtype=np.float64)
            v = self.factors[slot].astype(np.float64)
            out[has] += 0.5 * (np.add.reduceat(v, at) ** 2 - np.add.reduceat(v * v, at)).sum(1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def terms(piece: Piece, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return term_counts(*bare_words(piece), piece.n_docs, bits)


def fit_sparse(data: dict[str, np.ndarray], bits: int = BITS, factors: int = FACTORS, epochs: int = 80,
               rate: float = 0.05, decay: float = 1e-4, seed: int = 5,
               min_docs: int = 5, min_z: float = 4.0, held_back: tuple[float, float] = (0.1, 0.01)) -> Model:
    """Fit on sparse rows, on the terms of ``min_docs`` documents or more: rarer ones can only be
    learnt by heart. A term whose share of label 1 is less than ``min_z`` standard errors from the
    sample's stays, since it may count in a pair, but its weight and vector decay by ``held_back``.
    Without both labels the model is the constant share of 1."""
    y, weight = data["y"].astype(np.float64), data["weight"].astype(np.float64)
    share = (np.sum(weight * y) + 0.5) / (np.sum(weight) + 1.0)
    model = Model(float(np.log(share / (1 - share))), np.zeros(1 << bits, np.float32),
                  np.zeros((1 << bits, factors), np.float32))
    used, seen = np.unique(data["slot"], return_counts=True)
    if len(used):
        label_1 = np.bincount(np.searchsorted(used, data["slot"]), np.repeat(y, np.diff(data["bounds"])), len(used))
        rate_1 = y.mean()
        z = (label_1 - seen * rate_1) / np.sqrt(seen * max(rate_1 * (1 - rate_1), 1e-9))
        used, z = used[seen >= min_docs], z[seen >= min_docs]
        w_decay, v_decay = (np.where(np.abs(z) >= min_z, decay, x) for x in held_back)
    if len(y) == 0 or y.min() == y.max() or not len(used):
        return model
    where = np.searchsorted(used, data["slot"])
    where[where == len(used)] = 0
    keep = used[where] == data["slot"]
    row = np.repeat(np.arange(len(y)), np.diff(data["bounds"]))[keep]
    col = where[keep]
    by_col = np.argsort(col, kind="stable")
    row_of = row[by_col]
    col_at = np.searchsorted(col[by_col], np.arange(len(used)))
    rows_in, row_at = np.unique(row, return_index=True)

    def row_sum(x):
        out = np.zeros(len(y))
        out[rows_in] = np.add.reduceat(x, row_at)
        return out

    rng = np.random.default_rng(seed)
    w0, w, v = model.bias, np.zeros(len(used)), rng.normal(0, 0.02, (factors, len(used)))
    theta = np.concatenate(([w0], w, v.ravel()))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    importance = weight / weight.sum()
    for step in range(1, epochs + 1):
        w0, w, v = theta[0], theta[1:len(used) + 1], theta[len(used) + 1:].reshape(factors, -1)
        logit = w0 + row_sum(w[col])
        sums = np.zeros((factors, len(y)))
        for f in range(factors):
            x = v[f][col]
            sums[f] = row_sum(x)
            logit += 0.5 * (sums[f] ** 2 - row_sum(x * x))
        err = (sigmoid(logit) - y) * importance
        e = err[row_of]
        grad = np.empty_like(theta)
        grad[0] = err.sum()
        total = np.add.reduceat(e, col_at)
        grad[1:len(used) + 1] = total + w_decay * w
        g = grad[len(used) + 1:].reshape(factors, -1)
        for f in range(factors):
            g[f] = np.add.reduceat(e * sums[f][row_of], col_at) - v[f] * total + v_decay * v[f]
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        theta = theta - rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    linear, factor = model.linear, model.factors
    linear[used] = theta[1:len(used) + 1]
    factor[used] = theta[len(used) + 1:].reshape(factors, -1).T
    return Model(float(theta[0]), linear, factor)


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", per_class: int = PER_CLASS,
        bits: int = BITS) -> Model:
    sampled = labelled.sample(docs, labels, label, learn, per_class)
    return fit_sparse(labelled.sparse_sample(sampled, terms, bits), bits)


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row, repeated rows too. Null and empty texts get the bias alone,
    very long ones are read whole, an empty table gives no rows, other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(piece: Piece) -> np.ndarray:
        bounds, slot, _ = terms(piece, bits)
        return sigmoid(shared.value.logits(bounds, slot))

    return labelled.score_documents(docs, of)


def reject(docs: DataFrame, model: Model, cut: float = CUT, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with a score below ``cut``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [np.zeros(0, bool)]
            for p in pieces(batch.column(at)):
                bounds, slot, _ = terms(p, bits)
                fine.append(sigmoid(shared.value.logits(bounds, slot)) < cut)
            yield batch.filter(pa.array(np.concatenate(fine)))

    return docs.mapInArrow(keep, docs.schema)


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, ~labelled.held_out(4, 2))
    return score(docs, model).select("doc_id", labelled.held_out(4, 2).alias("held_out"), "score",
                                     (F.col("score") >= CUT).cast("int").alias("predicted"))
