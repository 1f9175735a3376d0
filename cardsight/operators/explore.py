"""Exploration summaries (G1-G6): the data behind each plot, as long tables.

Pattern used throughout: columns are turned into rows with one ``stack``/``explode``
(so any number of columns costs one scan), per-group statistics are a small aggregate
joined back NULL-safely, and all counting is map-side combined.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import literal, quoted
from ..session import scratch_table
from .joins import join_null_safe, join_static
from .ordered import all_columns_used, running_totals

GROUP = ["column", "class"]
MEASURE_DIGITS = 6
DENSITY_DIGITS = 9

# Fixed values (plot defaults): 1.5 IQR whiskers; Gaussian KDE on a 200-point grid that
# extends 3 bandwidths past the data, Scott's rule n^(-1/5).
WHISKER = 1.5
KDE_GRID = 200
KDE_CUT = 3.0


def _class_col(by: str | None) -> Column:
    return (F.col(quoted(by)).cast("string") if by else F.lit(None).cast("string")).alias("class")


def numeric_long(df: DataFrame, columns: list[str], by: str | None = None, finite: bool = False) -> DataFrame:
    """(column, class, x) for every non-NULL, non-NaN value of the listed columns;
    ``finite`` also leaves out infinite values, which have no bin."""
    by_class = f"CAST({quoted(by)} AS string)" if by else "CAST(NULL AS string)"
    cells = ", ".join(f"struct({literal(c)} AS column, CAST({quoted(c)} AS double) AS x)" for c in columns)
    long = df.selectExpr(f"{by_class} AS class", f"explode(array({cells})) AS _c").selectExpr("class", "_c.column", "_c.x")
    return long.where("NOT isnan(x) AND abs(x) < double('inf')" if finite else "x IS NOT NULL AND NOT isnan(x)")


def nonfinite_counts(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(column, class, n_null, n_nan, n_infinite): the values that binned summaries leave out."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("double").alias("x"))
                                for c in columns])).alias("_c")
    return df.select(_class_col(by), cells).groupBy("_c.column", "class").agg(
        F.count_if(F.col("_c.x").isNull()).alias("n_null"), F.count_if(F.isnan("_c.x")).alias("n_nan"),
        F.count_if(F.abs(F.col("_c.x")) == F.lit(float("inf"))).alias("n_infinite"))


# ---------------------------------------------------------------- crosstabs

def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts of two columns, long form (G1): (value_a, value_b, count)."""
    return (df.groupBy(F.col(a).cast("string").alias("value_a"), F.col(b).cast("string").alias("value_b"))
            .agg(F.count(F.lit(1)).alias("count")))


def crosstab_wide(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    """Wide crosstab (one column per value of ``b``; absent cells 0). Pass ``values`` to
    skip the distinct-values job ``pivot`` otherwise runs."""
    g = df.groupBy(F.col(a).alias(a))
    piv = g.pivot(b, values) if values is not None else g.pivot(b)
    return piv.agg(F.count(F.lit(1))).fillna(0)


def crosstab_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Crosstabs of every unordered pair of ``columns`` in one job.

    Each row emits one (pair, value_a, value_b) struct per pair - a fixed fan-out of
    n(n-1)/2 set by the column list - and the counts are combined map-side.
    """
    pairs = list(itertools.combinations(columns, 2))
    cells = F.explode(F.array(*[
        F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"),
                 F.col(x).cast("string").alias("value_a"), F.col(y).cast("string").alias("value_b"))
        for x, y in pairs]))
    return (df.select(cells.alias("c")).select("c.*")
            .groupBy("column_a", "column_b", "value_a", "value_b")
            .agg(F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------- histograms

def _sturges_fd_bins(n: Column, lo: Column, hi: Column, q1: Column, q3: Column) -> Column:
    """Number of bins from the smaller width of the Sturges and Freedman-Diaconis rules."""
    rng = hi - lo
    sturges = rng / (F.log(n) / F.log(F.lit(2.0)) + 1)
    fd = F.lit(2.0) * (q3 - q1) * F.pow(n, F.lit(-1.0 / 3.0))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    return F.when(rng > 0, F.ceil(rng / width)).otherwise(F.lit(1)).cast("bigint")


# Bins of a group are made in two steps, so no array holds more than this many of them.
BIN_BLOCK = 4096


def histogram(df: DataFrame, columns: list[str], by: str | None = None, bins: int | str = 10,
              digits: int = MEASURE_DIGITS, approx_quartiles: bool = False) -> DataFrame:
    """Equal-width histogram per column, each class binned separately.

    Edges span [min, max] of the (column, class) group; the last bin is closed on the
    right; a constant group gets the range [v - 0.5, v + 0.5]. ``bins='auto'`` picks the
    count per group from the smaller width of the Sturges and Freedman-Diaconis rules; its
    quartiles are exact (linear interpolation, via :func:`quartiles`) or, with
    ``approx_quartiles``, from a KLL sketch in the same aggregation.
    Empty bins are present with count 0. Infinite values are left out (see
    :func:`nonfinite_counts`). Output: column, class, bin, lo, hi, count.
    """
    long = numeric_long(df, columns, by, finite=True)
    aggs = [F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx")]
    if bins == "auto" and approx_quartiles:
        aggs.append(F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("x", F.lit(SKETCH_K)), F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    stats = long.groupBy("column", "class").agg(*aggs)
    if bins == "auto" and not approx_quartiles:
        qs = quartiles(long, (0.25, 0.75)).select(*GROUP, F.array("q0", "q1").alias("q"))
        stats = join_null_safe(stats, qs, GROUP, "inner")      # one row per group on both sides
    same = F.col("mn") == F.col("mx")
    lo = F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn"))
    hi = F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx"))
    nb = (_sturges_fd_bins(F.col("n").cast("double"), F.col("mn"), F.col("mx"), F.col("q")[0], F.col("q")[1])
          if bins == "auto" else F.lit(int(bins)).cast("bigint"))
    stats = stats.select("column", "class", lo.alias("lo"), hi.alias("hi"), nb.alias("nbins"))
    width = (F.col("hi") - F.col("lo")) / F.col("nbins")

    # One stats row per (column, class): joined back through a size-checked broadcast.
    binned = join_null_safe(long, stats, GROUP)
    b = F.least(F.floor((F.col("x") - F.col("lo")) / width).cast("bigint"), F.col("nbins") - 1)
    counts = binned.groupBy("column", "class", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    blocks = F.sequence(F.lit(0), F.floor((F.col("nbins") - 1) / BIN_BLOCK).cast("int"))
    first = F.col("block").cast("bigint") * BIN_BLOCK
    grid = stats.select("column", "class", "lo", "hi", "nbins", F.explode(blocks).alias("block")).select(
        "column", "class", "lo", "hi", "nbins",
        F.explode(F.sequence(first, F.least(first + (BIN_BLOCK - 1), F.col("nbins") - 1))).alias("bin"))
    out = join_null_safe(grid, counts, [*GROUP, "bin"], "left")
    return out.select(
        "column", "class", F.col("bin").cast("int" if bins != "auto" else "bigint").alias("bin"),
        F.round(F.col("lo") + F.col("bin") * width, digits).alias("lo"),
        F.round(F.when(F.col("bin") == F.col("nbins") - 1, F.col("hi"))
                .otherwise(F.col("lo") + (F.col("bin") + 1) * width), digits).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


# ---------------------------------------------------------------- kernel density

KDE_RADIUS = 0.25       # half a cell, in units of sqrt(2) bandwidths
KDE_ORDER = 16          # Hermite terms of a cell
KDE_REACH = 7.0         # a cell is left out beyond so many units: exp(-(7 - 1/4)^2) < 2e-20


def kde_error(order: int = KDE_ORDER, radius: float = KDE_RADIUS, reach: float = KDE_REACH) -> float:
    """Bound on the error of one point's kernel (largest value 1) in :func:`kde`, so also on the error of a
    density in units of 1 / (bandwidth * sqrt(2 pi)).

    A kernel is expanded around its cell's centre: exp(-(u - d)^2) = sum over m of d^m / m! h_m(u), with the
    Hermite functions h_m. As |h_m(u)| <= 1.0865 * 2^(m/2) * sqrt(m!) (Cramer), and |d| <= radius, the terms
    from ``order`` on add up to at most 1.0865 * sum of (sqrt(2) radius)^m / sqrt(m!)."""
    tail = sum((math.sqrt(2) * radius) ** m / math.sqrt(math.factorial(m)) for m in range(order, order + 80))
    return 1.0865 * tail + math.exp(-((reach - radius) ** 2))


def _hermite_polynomial(order: int) -> list[list[float]]:
    """coefficient[m][k] of u^k in h_m(u) * exp(u^2) / m!."""
    rows = [[1.0]]
    for m in range(1, order):
        nxt = [0.0] * (m + 1)
        for k, c in enumerate(rows[-1]):
            nxt[k + 1] += 2 * c
        for k, c in enumerate(rows[-2] if m > 1 else []):
            nxt[k] -= 2 * (m - 1) * c
        rows.append(nxt)
    return [[c / math.factorial(m) for c in row] for m, row in enumerate(rows)]


def kde(df: DataFrame, columns: list[str], by: str | None = None, grid_size: int = KDE_GRID,
        cut: float = KDE_CUT, bins: int | None = None, bw_adjust: float = 1.0,
        digits: int = DENSITY_DIGITS, order: int = KDE_ORDER) -> DataFrame:
    """Gaussian kernel density per (column, class) on an evenly spaced grid.

    Bandwidth = sample sd * n^(-1/5) * bw_adjust (Scott); grid from min - cut*bw to
    max + cut*bw. Computed by a fast Gauss transform: each group's range is cut into cells of
    ``2 * KDE_RADIUS`` units of sqrt(2) bandwidths, and a value adds the powers of its distance to the cell's
    centre to ``order`` moments. Moments are sums, so they are combined in each task and only (cells x moments)
    numbers are shuffled, no row meets a grid point; a cell then gives its Hermite series at the grid
    points it reaches. The error is at most :func:`kde_error` of the exact sum's unit. ``bins`` first moves the
    values to ``bins`` equal-width bin centres (error bounded by bin width). Groups with fewer than 2 values or
    zero spread are omitted. Output: column, class, grid_index, x, density.
    """
    long = numeric_long(df, columns, by, finite=True)
    stats = long.groupBy("column", "class").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("mn"),
        F.max("x").alias("mx"))
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.lit(float(bw_adjust))
    stats = (stats.where((F.col("n") >= 2) & (F.col("sd") > 0))
             .select("column", "class", "n", "mn", "mx", bw.alias("bw"))
             .withColumns({"g_lo": F.col("mn") - F.lit(float(cut)) * F.col("bw"),
                           "g_hi": F.col("mx") + F.lit(float(cut)) * F.col("bw"),
                           "unit": F.col("bw") * math.sqrt(2.0)}))
    points = join_null_safe(long, stats, GROUP)
    x = F.col("x")
    if bins:
        w = (F.col("mx") - F.col("mn")) / F.lit(int(bins))
        b = F.least(F.floor((x - F.col("mn")) / w).cast("int"), F.lit(int(bins) - 1))
        x = F.col("mn") + (b + 0.5) * w
    width, half = f"(unit * {2 * KDE_RADIUS!r}D)", f"{KDE_RADIUS!r}D"
    distance = points.withColumn("_x", x).selectExpr("*", f"floor((_x - mn) / {width}) AS cell") \
        .selectExpr("*", f"(_x - mn) / unit - (cell + 0.5D) * 2 * {half} AS _d")
    moments = ["CAST(count(1) AS double) AS m0", "sum(_d) AS m1", *[f"sum({' * '.join(['_d'] * m)}) AS m{m}" for m in range(2, order)]]
    cells = distance.groupBy("column", "class", "cell").agg(
        *[F.expr(m) for m in moments[:order]], *[F.expr(f"first({c}) AS {c}") for c in ("n", "mn", "bw", "unit", "g_lo", "g_hi")])

    # a cell's series as a polynomial in the distance of the grid point, times exp(-u^2)
    table = _hermite_polynomial(order)
    series = [" + ".join(f"m{m} * {table[m][k]!r}D" for m in range(k, order) if table[m][k]) for k in range(order)]
    step, centre, reach = f"((g_hi - g_lo) / {grid_size - 1})", f"(mn + (cell + 0.5D) * {width})", f"(unit * {KDE_REACH!r}D)"
    first = f"CAST(greatest(ceil(({centre} - {reach} - g_lo) / {step}), 0) AS int)"
    last = f"CAST(least(floor(({centre} + {reach} - g_lo) / {step}), {grid_size - 1}) AS int)"
    at = cells.selectExpr("*", f"{first} AS _first", f"{last} AS _last").where("_first <= _last") \
        .selectExpr("column", "class", "unit", "g_lo", "g_hi", f"{centre} AS _c", *[f"{p} AS p{k}" for k, p in enumerate(series)],
                    "explode(sequence(_first, _last)) AS grid_index") \
        .selectExpr("*", f"(g_lo + grid_index * {step} - _c) / unit AS _u")
    horner = f"p{order - 1}"
    for k in range(order - 2, -1, -1):
        horner = f"({horner}) * _u + p{k}"
    sums = at.groupBy("column", "class", "grid_index").agg(F.expr(f"sum(exp(-_u * _u) * ({horner})) AS s"))

    # every group has the whole grid, also where no cell reaches
    grid = stats.selectExpr("column", "class", "n", "bw", "g_lo", "g_hi", f"explode(sequence(0, {grid_size - 1})) AS grid_index")
    return join_null_safe(grid, sums, [*GROUP, "grid_index"], "left").selectExpr(
        "column", "class", "grid_index", f"round(g_lo + grid_index * {step}, {MEASURE_DIGITS}) AS x",
        f"round(greatest(coalesce(s, 0D), 0D) / (n * bw * {math.sqrt(2 * math.pi)!r}D), {digits}) AS density")


# ---------------------------------------------------------------- quantiles and box statistics

SKETCH_K = 4096


def rank_error(k: int = SKETCH_K) -> float:
    """Rank error of a KLL sketch of size ``k``, as a share of all values: a quantile's true rank is within
    it with 99 % confidence (published fit; 0.07 % at 4096)."""
    return 2.296 / k ** 0.9723


def value_sketches(long: DataFrame, keys: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """(keys..., n, mn, mx, sketch): count, extremes and a KLL sketch of ``x`` in one aggregate."""
    return long.groupBy(*(keys or GROUP)).agg(*[F.expr(e) for e in (
        "count(1) AS n", "min(x) AS mn", "max(x) AS mx", f"kll_sketch_agg_double(x, {k}) AS sketch")])


def merge_sketches(parts: DataFrame, keys: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """Sketches of the union of portions from the portions' own (:func:`value_sketches`)."""
    return parts.groupBy(*(keys or GROUP)).agg(
        F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """``q0``, ``q1``, ...: quantiles from sketches, each a value of the data whose rank is within :func:`rank_error`."""
    q = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs]))
    return sketches.withColumn("_q", q).select(*[c for c in sketches.columns if c != "sketch"],
                                               *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])


def _brackets(sketches: DataFrame, probs, k: int) -> DataFrame:
    """(column, class, n, mn, mx, lo, hi): for every probability two values between which the quantile lies.

    Three times the stated rank error is 7.7 standard errors; two ranks more cover the interpolation between
    neighbouring ranks. Up to ``k`` values the whole group is its own bracket. Sketches merge at random, so
    the brackets - one row a group - are written once and every later use reads the same ones."""
    slack = 3 * rank_error(k) + 2 / k

    def at(sign: int) -> str:
        return "kll_sketch_get_quantile_double(sketch, array(" + ", ".join(f"{min(1.0, max(0.0, p + sign * slack))!r}D" for p in probs) + "))"

    return scratch_table(sketches.selectExpr(
        *GROUP, "n", "mn", "mx", f"CASE WHEN n <= {k} THEN array_repeat(mn, {len(probs)}) ELSE {at(-1)} END AS lo",
        f"CASE WHEN n <= {k} THEN array_repeat(mx, {len(probs)}) ELSE {at(1)} END AS hi"), "brackets")


def _bracketed(long: DataFrame, brackets: DataFrame, n_brackets: int) -> DataFrame:
    """(column, class, i, zone, v, cnt, least, most, n, mn, mx): the values inside bracket i (zone 1) with their
    counts, and one row each for all values below (zone 0) and above it (zone 2)."""
    return join_null_safe(long, brackets, GROUP) \
        .selectExpr(*GROUP, "x", "lo", "hi", "n", "mn", "mx", f"explode(sequence(0, {n_brackets - 1})) AS i") \
        .selectExpr(*GROUP, "x", "n", "mn", "mx", "i", "CASE WHEN x < lo[i] THEN 0 WHEN x <= hi[i] THEN 1 ELSE 2 END AS zone") \
        .groupBy(*GROUP, "i", "zone", F.expr("CASE WHEN zone = 1 THEN x END AS v")) \
        .agg(*[F.expr(e) for e in ("count(1) AS cnt", "min(x) AS least", "max(x) AS most", "max(n) AS n", "max(mn) AS mn", "max(mx) AS mx")]) \
        .where(all_columns_used([*GROUP, "i", "zone", "v", "cnt", "least", "most", "n", "mn", "mx"]))


# Conditions on bracketed cells look at ``cnt`` too, so that they stay above the aggregate and all of a query's
# uses of the cells read one exchange.
_I = "(CASE WHEN cnt > 0 THEN i END)"


def _selected(cells: DataFrame, probs, ranges: int | None) -> DataFrame:
    """Exact quantiles from bracketed values: only the values inside the brackets are ranked."""
    # the count below a bracket has a null value: first in order, so the running count starts with it
    ranked = running_totals(cells.where(f"{_I} < {len(probs)} AND (CASE WHEN cnt > 0 THEN zone END) < 2"),
                            "v", ["cnt"], by=[*GROUP, "i"], ranges=ranges)
    ps = "array(" + ", ".join(f"{float(p)!r}D" for p in probs) + ")"
    # first and last: 0-based ranks of a value's copies
    ranked = ranked.selectExpr(*GROUP, "i", "v", "n", "cnt_cum - cnt AS first", "cnt_cum - 1 AS last", f"CAST(n - 1 AS double) * {ps}[i] AS h")
    each = ranked.groupBy(*GROUP, "i").agg(
        F.expr("first(n) AS n"), F.expr("max(CASE WHEN first <= floor(h) AND floor(h) <= last THEN v END) AS a"),
        F.expr("max(CASE WHEN first <= ceil(h) AND ceil(h) <= last THEN v END) AS b"), F.expr("max(h - floor(h)) AS f"))
    missed = "CAST(raise_error('a quantile lies outside its bracket: use a larger sketch (k)') AS double)"
    value = f"CASE WHEN a IS NULL OR b IS NULL THEN {missed} ELSE a + f * (b - a) END"
    return each.groupBy(*GROUP).agg(F.expr("first(n) AS n"), *[F.expr(f"max(CASE WHEN i = {i} THEN {value} END) AS q{i}") for i in range(len(probs))])


def quartiles(long: DataFrame, probs=(0.25, 0.5, 0.75), ranges: int | None = None, k: int = SKETCH_K) -> DataFrame:
    """Exact linear-interpolation quantiles per (column, class): column, class, n, q0, q1, ...

    A first pass makes one KLL sketch a group, whose quantiles bracket each rank; a second pass counts what
    lies below a bracket and keeps the values inside (well under a hundredth of all), which alone are ranked, by
    :func:`running_totals`. A rank outside its bracket - 7.7 standard errors off - fails instead of giving a
    wrong value."""
    brackets = _brackets(value_sketches(long, k=k), probs, k)
    return _selected(_bracketed(long, brackets, len(probs)), probs, ranges)


def box_stats(df: DataFrame, columns: list[str], by: str | None = None, whisker: float = WHISKER,
              approx: bool = False, k: int = SKETCH_K, digits: int = MEASURE_DIGITS) -> DataFrame:
    """Box-plot statistics per (column, class).

    Quartiles by linear interpolation (exact by default, see :func:`quartiles`; ``approx=True`` takes values
    from the KLL sketches, off by :func:`rank_error` of the ranks). Whiskers reach the most extreme value inside
    [q1 - w*IQR, q3 + w*IQR] (never inside the box); values beyond them are outliers.
    Two passes: sketches and extremes; then the values inside the brackets of the quartiles and of both fences
    (which follow from the quartiles' brackets), with everything below and above as counts and extremes.
    Output: column, class, n, q1, median, q3, iqr, whisker_lo, whisker_hi, n_outliers, min, max.
    """
    long = numeric_long(df, columns, by)
    probs, w = (0.25, 0.5, 0.75), f"{float(whisker)!r}D"
    sketches = value_sketches(long, k=k)
    if approx:
        q = scratch_table(sketch_quantiles(sketches, probs), "quartiles")
        b = q.selectExpr(*GROUP, "n", "mn", "mx", "array(q0, q1, q2) AS lo", "array(q0, q1, q2) AS hi")
    else:
        b = _brackets(sketches, probs, k)
    # the fences at the ends of the quartiles' brackets, by the formula that gives the fences themselves
    inf = "double('inf')"
    b = b.selectExpr(
        *GROUP, "n", "mn", "mx",
        f"concat(lo, array(nanvl(lo[0] - {w} * (hi[2] - lo[0]), -{inf}), nanvl(lo[2] + {w} * (lo[2] - hi[0]), -{inf}))) AS lo",
        f"concat(hi, array(nanvl(hi[0] - {w} * (lo[2] - hi[0]), {inf}), nanvl(hi[2] + {w} * (hi[2] - lo[0]), {inf}))) AS hi")
    cells = _bracketed(long, b, len(probs) + 2)
    if not approx:
        q = _selected(cells, probs, None)
    q = q.selectExpr(*GROUP, "q0", "q1", "q2", "q2 - q0 AS iqr",
                     f"q0 - {w} * (q2 - q0) AS f_lo", f"q2 + {w} * (q2 - q0) AS f_hi")

    # A value below the lower whisker is exactly a value below the lower fence (the
    # whisker is the smallest value at or above the fence, or q1 when none lies in
    # [fence, q1]); likewise above.
    lower, upper = f"i = {len(probs)}", f"i = {len(probs) + 1}"
    j = join_null_safe(cells.where(f"{_I} >= {len(probs)}"), q, GROUP).selectExpr(
        "*", f"coalesce(({lower} AND (zone = 0 OR v < f_lo)) OR ({upper} AND (zone = 2 OR v > f_hi)), false) AS outside")
    res = j.groupBy("column", "class").agg(
        *[F.expr(f"first({c}) AS {c}") for c in ("n", "q0", "q1", "q2", "iqr", "mn", "mx")],
        F.expr(f"min(CASE WHEN {lower} AND NOT outside THEN least END) AS in_lo"),
        F.expr(f"max(CASE WHEN {upper} AND NOT outside THEN most END) AS in_hi"),
        F.expr("sum(CASE WHEN outside THEN cnt ELSE 0 END) AS n_outliers"))
    measures = {"q1": "q0", "median": "q1", "q3": "q2", "iqr": "iqr", "whisker_lo": "least(coalesce(in_lo, q0), q0)",
                "whisker_hi": "greatest(coalesce(in_hi, q2), q2)"}
    return res.selectExpr("column", "class", "n", *[f"round({e}, {digits}) AS {m}" for m, e in measures.items()], "n_outliers",
                          f"round(mn, {digits}) AS min", f"round(mx, {digits}) AS max")


# ---------------------------------------------------------------- scatter

def scatter_bins(df: DataFrame, columns: list[str], by: str | None = None, bins: int = 10,
                 digits: int = MEASURE_DIGITS) -> DataFrame:
    """2-D binned counts for every pair of numeric columns, per class.

    The density-preserving summary of a scatter plot: each axis is cut into ``bins``
    equal-width bins over the column's overall [min, max] (shared by all classes, so
    class layers align). Rows with NULL/NaN in either column of a pair are left out of
    that pair, and so are infinite ones. Output: column_x, column_y, class, bin_x, bin_y, count.
    """
    long = numeric_long(df, columns, by, finite=True)
    lim = long.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    pairs = list(itertools.combinations(columns, 2))
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("column_x"), F.lit(b).alias("column_y"),
                 F.col(quoted(a)).cast("double").alias("vx"), F.col(quoted(b)).cast("double").alias("vy"))
        for a, b in pairs]))
    pts = df.select(_class_col(by), cells.alias("c")).select("class", "c.*")
    pts = pts.where((F.abs("vx") < F.lit(float("inf"))) & (F.abs("vy") < F.lit(float("inf"))))
    # ``lim`` has one row per listed column: its size is fixed by the arguments.
    lx = lim.select(F.col("column").alias("column_x"), F.col("lo").alias("lo_x"), F.col("hi").alias("hi_x"))
    ly = lim.select(F.col("column").alias("column_y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"))
    pts = join_static(join_static(pts, lx, "column_x"), ly, "column_y")

    def bin_of(v, lo, hi):
        width = (F.col(hi) - F.col(lo)) / F.lit(bins)
        return F.when(F.col(hi) == F.col(lo), F.lit(0)).otherwise(
            F.least(F.floor((F.col(v) - F.col(lo)) / width).cast("int"), F.lit(bins - 1)))

    return (pts.groupBy("column_x", "column_y", "class",
                        bin_of("vx", "lo_x", "hi_x").alias("bin_x"), bin_of("vy", "lo_y", "hi_y").alias("bin_y"))
            .agg(F.count(F.lit(1)).alias("count")))
