"""Embedding whitening (operator 12): leading principal components at unit variance.

Vectors are put on an integer lattice, x = floor(256 c), and every distinct lattice vector counts once in
the fit. Spark makes the statistics in two passes over the fit list: counts and sums of each dimension, then
the products of vectors centred on the rounded mean. Those are sums of integers, so they are exact (up to
2^53 a cell) and the same on any layout; the rest of the centring, half a step a dimension at most, is taken
off afterwards. The covariance is as large as a vector is long, whatever the number of rows, and its leading
eigenvectors are found on the driver: Householder reflections make it tridiagonal, bisection on Sturm counts
brackets the leading eigenvalues one by one, and inverse iteration gives their vectors, orthogonalised again
within clusters of near-equal eigenvalues. The components are broadcast and every row is projected where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, stored, table

SCALE = 256
COMPONENTS = 4
RANK = 1e-12      # an eigenvalue below this share of the trace counts as zero
CLUSTER = 1e-3    # eigenvalues closer than this share of the largest are one cluster
EXACT = 2.0 ** 53


# ------------------------------------------------------------------ the lattice and its statistics (Spark)

def lattice(frame: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): ``floor(scale * c)`` as long for every entry of the rows without a null, NaN or infinite
    entry; so are entries that leave the range of a long when scaled. Shorter vectors end in zeros."""
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    fits = F.forall(vector, lambda c: c.isNotNull() & (F.abs(scaled(c)) < F.lit(2.0 ** 63)))
    rows = frame.select("vec_id", F.when(F.col(vector).isNotNull() & fits, F.transform(
        vector, lambda c: F.floor(scaled(c)).cast("long"))).alias("x")).where("x is not null")
    widths = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if widths[0] != widths[1]:
        fill = F.array_repeat(F.lit(0).cast("long"), F.lit(widths[1]) - F.size("x"))
        rows = rows.select("vec_id", F.concat("x", fill).alias("x"))
    return rows


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as an integer matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def products(rows: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the rows, by blocks small enough for exact integers where there are any."""
    top = float(np.abs(rows).max(initial=0.0))
    block = int(min(len(rows), max(1.0, EXACT / max(top * top, 1.0))))
    out = np.zeros((rows.shape[1], rows.shape[1]))
    for at in range(0, len(rows), max(block, 1)):
        part = rows[at:at + block].astype(np.float64)
        out += part.T @ part
    return out


def cell_sums(frame: DataFrame, make) -> np.ndarray | None:
    """The sum over all batches of the square matrices that ``make`` gives for a column of vectors: added up
    in each task, then by Spark for each cell of the upper triangle."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = make(batch.column(0))
                total = got if total is None else total + got
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                                             names=["i", "j", "v"])

    cells = frame.select("x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    rows = cells.collect()        # bounded by the square of the vector length
    if not rows:
        return None
    size = max(r.j for r in rows) + 1
    out = np.zeros((size, size))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


class Centre(NamedTuple):
    n: int                  # distinct lattice vectors
    sums: list[int]         # exact sum of each dimension
    near: np.ndarray        # rounded mean
    off: np.ndarray         # mean minus rounded mean, at most a half


def centre(fit: DataFrame) -> Centre | None:
    """Number and exact sums of the fit list, one row a dimension; None for an empty list."""
    cells = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not cells:
        return None
    n, sums = int(cells[0].n), [int(r.s) for r in cells]
    near = [(2 * s + n) // (2 * n) for s in sums]
    return Centre(n, sums, np.array(near, np.int64), np.array([(s - m * n) / n for s, m in zip(sums, near)]))


def covariance(fit: DataFrame, c: Centre) -> np.ndarray:
    """Covariance of the fit list, divisor n, centred before multiplying."""
    near, dims = c.near, len(c.near)
    total = cell_sums(fit, lambda column: products(matrix(column, dims) - near))
    return total / c.n - np.outer(c.off, c.off)


# ------------------------------------------------------------------ eigenvectors (one matrix, on the driver)

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, subdiagonal, reflections): Householder reflections that make a symmetric matrix tridiagonal."""
    a, n, reflections = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.abs(x).max()
        if size == 0 or not np.abs(x[1:]).max() > 0:
            reflections.append(np.zeros(n - k - 1))
            continue
        x /= size
        x[0] += np.copysign(np.sqrt(x @ x), x[0])
        v = x / np.sqrt(x @ x)
        reflections.append(v)
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def count_below(d: np.ndarray, e: np.ndarray, x: float, least: float) -> int:
    """Sturm count: how many eigenvalues of the tridiagonal matrix lie below ``x``."""
    below, q = 0, 1.0
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] * e[i - 1] / q if i else 0.0)
        if abs(q) < least:
            q = -least
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected down to neighbouring numbers."""
    n = len(d)
    radius = np.zeros(n)
    radius[:-1] += np.abs(e)
    radius[1:] += np.abs(e)
    low, high = float((d - radius).min()), float((d + radius).max())
    width = max(abs(low), abs(high), np.finfo(float).tiny)
    least = max(np.finfo(float).tiny, (np.finfo(float).eps * width) ** 2)
    low, high, out = low - 1e-12 * width, high + 1e-12 * width, []
    for nth in range(1, k + 1):        # the nth largest has n - nth eigenvalues below it
        lo, hi = low, out[-1] if out else high
        hi = max(hi, lo)
        while True:
            mid = lo + (hi - lo) / 2
            if not lo < mid < hi:
                break
            if count_below(d, e, mid, least) <= n - nth:
                lo = mid
            else:
                hi = mid
        out.append(lo + (hi - lo) / 2)
    return np.array(out)


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift) x = b by elimination with row exchanges; zero pivots become ``least``."""
    n = len(d)
    main, up, up2, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        low = e[i]
        if abs(main[i]) >= abs(low):
            if abs(main[i]) < least:
                main[i] = least
            f = low / main[i]
            main[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
        else:                          # the rows i and i + 1 change places
            f = main[i] / low
            main[i], up[i], main[i + 1], up2[i] = low, main[i + 1], up[i] - f * main[i + 1], up[i + 1]
            up[i + 1] = -f * up2[i]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(n - 1, -1, -1):
        if abs(main[i]) < least:
            main[i] = least
        x[i] -= (up[i] * x[i + 1] if i + 1 < n else 0.0) + (up2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] /= main[i]
        size = abs(x[i])
        if size > 1e250:               # keep the growing solution inside the range of doubles
            x /= size
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; members of a cluster are kept orthogonal."""
    n = len(d)
    width = float(max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny))
    least, rng = np.finfo(float).eps * width, np.random.default_rng(1)
    vectors: list[np.ndarray] = []
    for k, value in enumerate(values):
        first = k
        while first and values[first - 1] - values[first] <= CLUSTER * width:
            first -= 1
        cluster = vectors[first:k]
        shift = value - (k - first) * 4 * least        # equal shifts would find the same vector again
        x = rng.standard_normal(n)
        for _ in range(rounds):
            x = solve_shifted(d, e, shift, x / np.sqrt(x @ x), least)
            x /= np.abs(x).max()
            for _ in range(2):
                for v in cluster:
                    x -= (v @ x) * v
        vectors.append(x / np.sqrt(x @ x))
    return np.stack(vectors, axis=1)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    d, e, reflections = tridiagonal(a)
    values = leading_values(d, e, k)
    vectors = leading_vectors(d, e, values)
    for at in range(len(reflections) - 1, -1, -1):     # back to the coordinates of ``a``
        v = reflections[at]
        vectors[at + 1:] -= 2 * np.outer(v, v @ vectors[at + 1:])
    return values, vectors / np.sqrt((vectors * vectors).sum(axis=0))


# ------------------------------------------------------------------ the operator

class Whitening(NamedTuple):
    centre: Centre
    values: np.ndarray      # leading eigenvalues
    vectors: np.ndarray     # unit eigenvectors as columns
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on the components, at unit variance."""
        return ((x - self.centre.near) - self.centre.off) @ self.vectors / np.sqrt(self.values)


def deviations(x: np.ndarray, c: Centre) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2 for each row, exact; None beyond a long."""
    sums, top = c.sums, c.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in c.sums), default=0)
    if top * top * x.shape[1] < 2 ** 63:
        y = c.n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = (sum((c.n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist())
    return [v if v < 2 ** 63 else None for v in exact]


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors of :func:`lattice`; None if the list is empty or does not vary."""
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    c = centre(fit)
    if c is None:
        return None
    v = covariance(fit, c)
    trace = float(np.trace(v))
    if not trace > 0:
        return None
    values, vectors = leading(v, min(components, len(v)))
    kept = values > RANK * trace
    w = Whitening(c, values[kept], vectors[:, kept], trace, 0.0)
    dims = len(v)
    whitened = cell_sums(fit, lambda column: (p := w.project(matrix(column, dims))).T @ p) / c.n
    return w._replace(identity_error=float(np.abs(whitened - np.eye(len(whitened))).max()))


def whiten(frame: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each usable row and component: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    Rows whose vector is null, or holds a null, NaN or infinite entry (or one that leaves the range of a long
    when scaled), are left out. Shorter vectors count as ending in zeros. Rows may share a vec_id or have none:
    each gives its own result; repeated vectors count once in the fit. Components without variance (below
    ``RANK`` of the trace) do not exist, so fewer than ``components`` may come back: none for a single distinct
    vector or an empty table. ``deviation`` is null where it does not fit a long. Equal eigenvalues share a
    space of components, of which one orthogonal choice is taken for all rows. Other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = frame.sparkSession
    rows = lattice(frame, vector, scale)
    model = fit_whitening(rows, components)
    if model is None:
        return spark.createDataFrame([], schema)
    shared, k, dims = spark.sparkContext.broadcast(model), len(model.values), len(model.centre.near)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            x = matrix(batch.column(1), dims)
            n = len(x)
            repeat = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, w.centre.n)), pa.array(deviations(x, w.centre), pa.int64()).take(repeat),
                pa.array(w.project(x).ravel()), pa.array(np.tile(w.values / w.trace, n)),
                pa.array(np.full(n * k, w.identity_error))], names=[f.strip().split(" ")[0] for f in schema.split(",")])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, schema)


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
