"""Queries: exploration summaries (G1-G6) over the prepared transaction view."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import explore
from ..operators.joins import join_null_safe
from ..sources.tables import AS_OF, TXN_SQL
from .q_prepare import prepared_txn
from .registry import query

P = f"""WITH txn AS ({TXN_SQL}),
p AS (SELECT *, CAST(trunc(datediff('day', dob, DATE '{AS_OF}') / 365) AS INTEGER) AS age,
             CAST(hour(trans_ts) AS INTEGER) AS trans_hour FROM txn)"""

HIST_COLS = ["amt", "age"]
HIST_BINS = 10
KDE_COLS = ["amt", "age"]
KDE_BINS = 512
BOX_COLS = ["amt", "age", "city_pop"]
SCATTER_COLS = ["amt", "age", "trans_hour"]
SCATTER_BINS = 10
CROSSTAB_COLS = ["category", "gender", "job"]


def _long_sql(cols: list[str], by: str | None) -> str:
    cls = f"CAST({by} AS VARCHAR)" if by else "CAST(NULL AS VARCHAR)"
    parts = " UNION ALL ".join(f"SELECT {cls} AS class, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM p"
                               for c in cols)
    return f"long AS (SELECT * FROM ({parts}) WHERE x IS NOT NULL AND NOT isnan(x))"


@query("crosstab", f"""{P}
SELECT CAST(category AS VARCHAR) AS value_a, CAST(gender AS VARCHAR) AS value_b, count(*) AS count
FROM p GROUP BY ALL""")
def q_crosstab(spark, sf_dir):
    return explore.crosstab(prepared_txn(spark, sf_dir), "category", "gender")


GENDERS = ["F", "M"]


@query("crosstab_wide", f"""{P}
SELECT category, {', '.join(f"count(*) FILTER (WHERE gender = '{g}') AS {g}" for g in GENDERS)}
FROM p GROUP BY category""")
def q_crosstab_wide(spark, sf_dir):
    return explore.crosstab_wide(prepared_txn(spark, sf_dir), "category", "gender", GENDERS)


@query("crosstab_pairs", f"""{P}
{' UNION ALL '.join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, CAST({a} AS VARCHAR) AS value_a, CAST({b} AS VARCHAR) AS value_b, count(*) AS count FROM p GROUP BY ALL" for a, b in itertools.combinations(CROSSTAB_COLS, 2))}""")
def q_crosstab_pairs(spark, sf_dir):
    return explore.crosstab_pairs(prepared_txn(spark, sf_dir), CROSSTAB_COLS)


def _hist_sql(cols, by, bins):
    if bins == "auto":    # smaller width of Sturges and Freedman-Diaconis, exact quartiles
        quart = ", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3"
        sturges = "(mx - mn) / (ln(CAST(n AS DOUBLE)) / ln(2.0) + 1)"
        fd = "(2.0 * (q3 - q1) * pow(CAST(n AS DOUBLE), -1.0 / 3.0))"
        nb = (f"CASE WHEN mx - mn > 0 THEN CAST(ceil((mx - mn) / CASE WHEN {fd} > 0 THEN least({fd}, {sturges}) "
              f"ELSE {sturges} END) AS INTEGER) ELSE 1 END")
    else:
        quart, nb = "", str(bins)
    return f"""{P}, {_long_sql(cols, by)},
a AS (SELECT "column", class, count(*) AS n, min(x) AS mn, max(x) AS mx{quart} FROM long GROUP BY ALL),
st AS (SELECT "column", class, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
              CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi, {nb} AS nbins FROM a),
cnt AS (SELECT l."column", l.class,
               least(CAST(floor((x - lo) / ((hi - lo) / nbins)) AS INTEGER), nbins - 1) AS bin, count(*) AS c
        FROM long l JOIN st ON l."column" = st."column" AND l.class IS NOT DISTINCT FROM st.class GROUP BY ALL),
grid AS (SELECT "column", class, lo, hi, nbins, CAST(unnest(range(nbins)) AS INTEGER) AS bin FROM st)
SELECT g."column", g.class, g.bin, round(lo + g.bin * ((hi - lo) / nbins), 6) AS lo,
       round(CASE WHEN g.bin = nbins - 1 THEN hi ELSE lo + (g.bin + 1) * ((hi - lo) / nbins) END, 6) AS hi,
       CAST(COALESCE(c, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt ON g."column" = cnt."column" AND g.class IS NOT DISTINCT FROM cnt.class AND g.bin = cnt.bin"""


@query("histogram", _hist_sql(["amt", "trans_hour"], None, HIST_BINS))
def q_histogram(spark, sf_dir):
    return explore.histogram(prepared_txn(spark, sf_dir), ["amt", "trans_hour"], bins=HIST_BINS)


@query("histogram_by", _hist_sql(HIST_COLS, "is_fraud", HIST_BINS))
def q_histogram_by(spark, sf_dir):
    return explore.histogram(prepared_txn(spark, sf_dir), HIST_COLS, by="is_fraud", bins=HIST_BINS)


@query("kde", f"""{P}, {_long_sql(KDE_COLS, 'is_fraud')},
st AS (SELECT "column", class, count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx
       FROM long GROUP BY ALL HAVING count(*) >= 2 AND stddev_samp(x) > 0),
st2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) * 1.0 AS bw FROM st),
st3 AS (SELECT *, mn - 3.0 * bw AS g_lo, mx + 3.0 * bw AS g_hi FROM st2),
pts AS (SELECT "column", class, x, count(*) AS cnt FROM long GROUP BY ALL),
grid AS (SELECT "column", class, CAST(unnest(range({explore.KDE_GRID})) AS INTEGER) AS j FROM st3),
terms AS (
  SELECT s."column", s.class, g.j, s.n, s.bw, s.g_lo, s.g_hi,
         p.cnt * exp(-0.5 * ((s.g_lo + g.j * ((s.g_hi - s.g_lo) / {explore.KDE_GRID - 1})) - p.x) / s.bw
                             * (((s.g_lo + g.j * ((s.g_hi - s.g_lo) / {explore.KDE_GRID - 1})) - p.x) / s.bw)) AS t
  FROM st3 s JOIN grid g ON s."column" = g."column" AND s.class = g.class
             JOIN pts p ON s."column" = p."column" AND s.class = p.class)
SELECT "column", class, j AS grid_index, round(g_lo + j * ((g_hi - g_lo) / {explore.KDE_GRID - 1}), 6) AS x,
       round(sum(t) / (n * bw * sqrt(2 * pi())), 9) AS density
FROM terms GROUP BY "column", class, j, n, bw, g_lo, g_hi""")
def q_kde(spark, sf_dir):
    return explore.kde(prepared_txn(spark, sf_dir), KDE_COLS, by="is_fraud")


def _kde_binned_sql(cols, by, bins):
    g = explore.KDE_GRID
    return f"""{P}, {_long_sql(cols, by)},
st AS (SELECT "column", class, count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx
       FROM long GROUP BY ALL HAVING count(*) >= 2 AND stddev_samp(x) > 0),
st3 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) * 1.0 AS bw FROM st),
st4 AS (SELECT *, mn - 3.0 * bw AS g_lo, mx + 3.0 * bw AS g_hi, (mx - mn) / {bins} AS w FROM st3),
pts AS (SELECT l."column", l.class,
               s.mn + (least(CAST(floor((l.x - s.mn) / s.w) AS INTEGER), {bins - 1}) + 0.5) * s.w AS x, count(*) AS cnt
        FROM long l JOIN st4 s ON l."column" = s."column" AND l.class = s.class GROUP BY ALL),
grid AS (SELECT "column", class, CAST(unnest(range({g})) AS INTEGER) AS j FROM st4),
terms AS (
  SELECT s."column", s.class, g.j, s.n, s.bw, s.g_lo, s.g_hi,
         p.cnt * exp(-0.5 * ((s.g_lo + g.j * ((s.g_hi - s.g_lo) / {g - 1})) - p.x) / s.bw
                             * (((s.g_lo + g.j * ((s.g_hi - s.g_lo) / {g - 1})) - p.x) / s.bw)) AS t
  FROM st4 s JOIN grid g ON s."column" = g."column" AND s.class = g.class
             JOIN pts p ON s."column" = p."column" AND s.class = p.class)
SELECT "column", class, j AS grid_index, round(g_lo + j * ((g_hi - g_lo) / {g - 1}), 6) AS x,
       round(sum(t) / (n * bw * sqrt(2 * pi())), 9) AS density
FROM terms GROUP BY "column", class, j, n, bw, g_lo, g_hi"""


@query("kde_binned", _kde_binned_sql(KDE_COLS, "is_fraud", KDE_BINS))
def q_kde_binned(spark, sf_dir):
    return explore.kde(prepared_txn(spark, sf_dir), KDE_COLS, by="is_fraud", bins=KDE_BINS)


@query("box_stats", f"""{P}, {_long_sql(BOX_COLS, 'is_fraud')},
q AS (SELECT "column", class, count(*) AS n, quantile_cont(x, 0.25) AS q0, quantile_cont(x, 0.5) AS q1,
             quantile_cont(x, 0.75) AS q2 FROM long GROUP BY ALL),
qf AS (SELECT *, q2 - q0 AS iqr, q0 - 1.5 * (q2 - q0) AS f_lo, q2 + 1.5 * (q2 - q0) AS f_hi FROM q),
e AS (SELECT l."column", l.class, min(CASE WHEN x >= f_lo THEN x END) AS in_lo,
             max(CASE WHEN x <= f_hi THEN x END) AS in_hi, min(x) AS mn, max(x) AS mx
      FROM long l JOIN qf ON l."column" = qf."column" AND l.class = qf.class GROUP BY ALL),
w AS (SELECT qf.*, least(COALESCE(in_lo, q0), q0) AS wlo, greatest(COALESCE(in_hi, q2), q2) AS whi, mn, mx
      FROM qf JOIN e ON qf."column" = e."column" AND qf.class = e.class),
o AS (SELECT l."column", l.class, count(*) FILTER (WHERE x < wlo OR x > whi) AS n_out
      FROM long l JOIN w ON l."column" = w."column" AND l.class = w.class GROUP BY ALL)
SELECT w."column", w.class, CAST(n AS BIGINT) AS n, round(q0, 6) AS q1, round(q1, 6) AS median, round(q2, 6) AS q3,
       round(iqr, 6) AS iqr, round(wlo, 6) AS whisker_lo, round(whi, 6) AS whisker_hi,
       CAST(n_out AS BIGINT) AS n_outliers, round(mn, 6) AS min, round(mx, 6) AS max
FROM w JOIN o ON w."column" = o."column" AND w.class = o.class""")
def q_box_stats(spark, sf_dir):
    return explore.box_stats(prepared_txn(spark, sf_dir), BOX_COLS, by="is_fraud")


def _scatter_sql():
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS column_x, '{b}' AS column_y, CAST(is_fraud AS VARCHAR) AS class, "
        f"CAST({a} AS DOUBLE) AS vx, CAST({b} AS DOUBLE) AS vy FROM p"
        for a, b in itertools.combinations(SCATTER_COLS, 2))
    n = SCATTER_BINS
    return f"""{P}, {_long_sql(SCATTER_COLS, 'is_fraud')},
lim AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM long GROUP BY 1),
pts AS (SELECT * FROM ({pairs}) WHERE vx IS NOT NULL AND NOT isnan(vx) AND vy IS NOT NULL AND NOT isnan(vy))
SELECT column_x, column_y, class,
  CASE WHEN lx.hi = lx.lo THEN 0 ELSE least(CAST(floor((vx - lx.lo) / ((lx.hi - lx.lo) / {n})) AS INTEGER), {n - 1}) END AS bin_x,
  CASE WHEN ly.hi = ly.lo THEN 0 ELSE least(CAST(floor((vy - ly.lo) / ((ly.hi - ly.lo) / {n})) AS INTEGER), {n - 1}) END AS bin_y,
  count(*) AS count
FROM pts JOIN lim lx ON pts.column_x = lx."column" JOIN lim ly ON pts.column_y = ly."column"
GROUP BY ALL"""


@query("scatter_bins", _scatter_sql())
def q_scatter_bins(spark, sf_dir):
    return explore.scatter_bins(prepared_txn(spark, sf_dir), SCATTER_COLS, by="is_fraud", bins=SCATTER_BINS)


@query("histogram_auto")
def q_histogram_auto(spark, sf_dir):
    """Bin count per group from the Sturges / Freedman-Diaconis rule (quartiles approximate)."""
    return explore.histogram(prepared_txn(spark, sf_dir), HIST_COLS, by="is_fraud", bins="auto",
                             approx_quartiles=True)


@query("histogram_auto_exact", _hist_sql(HIST_COLS, "is_fraud", "auto"))
def q_histogram_auto_exact(spark, sf_dir):
    """Bin count per group from the Sturges / Freedman-Diaconis rule with exact quartiles."""
    return explore.histogram(prepared_txn(spark, sf_dir), HIST_COLS, by="is_fraud", bins="auto")


@query("box_stats_approx")
def q_box_stats_approx(spark, sf_dir):
    """Box statistics from KLL sketches (bounded memory per group)."""
    return explore.box_stats(prepared_txn(spark, sf_dir), BOX_COLS, by="is_fraud", approx=True)


@query("sketch_quartiles", f"""{P}, {_long_sql(BOX_COLS, 'is_fraud')}
SELECT "column", class, count(*) AS n, round(min(x), 6) AS min, round(max(x), 6) AS max, TRUE AS within FROM long GROUP BY ALL""")
def q_sketch_quartiles(spark, sf_dir):
    """Quartiles from the merged KLL sketches of the two portions: counts and extremes are exact, and the
    share of values up to each quartile, counted afterwards, is within the sketch's rank error."""
    probs = (0.25, 0.5, 0.75)
    p = prepared_txn(spark, sf_dir)
    portions = [explore.value_sketches(explore.numeric_long(p.where(F.col("portion") == x), BOX_COLS, "is_fraud"))
                for x in ("train", "test")]
    q = explore.sketch_quantiles(explore.merge_sketches(portions[0].unionByName(portions[1])), probs)
    rows = join_null_safe(explore.numeric_long(p, BOX_COLS, "is_fraud"), q, explore.GROUP)
    counts = rows.groupBy(*explore.GROUP).agg(
        *[F.first(c).alias(c) for c in ("n", "mn", "mx")],
        *[F.count_if(F.col("x") < F.col(f"q{i}")).alias(f"b{i}") for i in range(len(probs))],
        *[F.count_if(F.col("x") <= F.col(f"q{i}")).alias(f"a{i}") for i in range(len(probs))])
    off = explore.rank_error()
    near = [(F.col(f"b{i}") / F.col("n") <= x + off) & (F.col(f"a{i}") / F.col("n") >= x - off) for i, x in enumerate(probs)]
    return counts.select(*explore.GROUP, "n", F.round("mn", 6).alias("min"), F.round("mx", 6).alias("max"),
                         (near[0] & near[1] & near[2]).alias("within"))
