"""Queries: the same operators on other driver tables (``lineitem``, ``part``).

``lineitem.l_discount`` has true zeros (ln -> NULL), returnflag x linestatus gives a
3 x 2 crosstab and a 3-class grouping; ``part`` has 25 brands and 6 types to index.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ..operators import distribution, explore, features
from ..sources.tables import table
from .registry import query

LI_LOG_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_BOX_COLS = ["l_quantity", "l_extendedprice"]
PART_CATS = ["p_brand", "p_type"]


@query("lineitem_crosstab", """
SELECT CAST(l_returnflag AS VARCHAR) AS value_a, CAST(l_linestatus AS VARCHAR) AS value_b, count(*) AS count
FROM lineitem GROUP BY ALL""")
def q_lineitem_crosstab(spark, sf_dir):
    return explore.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("lineitem_logs", f"""
SELECT l_orderkey, l_linenumber, {', '.join(
    f'round(CASE WHEN {c} > 0 THEN ln({c}) END, 6) AS ln_{c}' for c in LI_LOG_COLS)}
FROM lineitem""")
def q_lineitem_logs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    lt = features.LogTransformer(inputCols=LI_LOG_COLS)
    return lt.transform(li).select("l_orderkey", "l_linenumber",
                                   *[F.round(c, 6).alias(c) for c in lt.getOutputCols()])


@query("lineitem_box_stats", f"""
WITH long AS (
  SELECT * FROM ({' UNION ALL '.join(
      f"SELECT CAST(l_returnflag AS VARCHAR) AS class, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM lineitem"
      for c in LI_BOX_COLS)}) WHERE x IS NOT NULL AND NOT isnan(x)),
q AS (SELECT "column", class, count(*) AS n, quantile_cont(x, 0.25) AS q0, quantile_cont(x, 0.5) AS q1,
             quantile_cont(x, 0.75) AS q2 FROM long GROUP BY ALL),
qf AS (SELECT *, q2 - q0 AS iqr, q0 - 1.5 * (q2 - q0) AS f_lo, q2 + 1.5 * (q2 - q0) AS f_hi FROM q),
e AS (SELECT l."column", l.class, min(CASE WHEN x >= f_lo THEN x END) AS in_lo,
             max(CASE WHEN x <= f_hi THEN x END) AS in_hi, min(x) AS mn, max(x) AS mx,
             count(*) FILTER (WHERE x < f_lo OR x > f_hi) AS n_out
      FROM long l JOIN qf ON l."column" = qf."column" AND l.class = qf.class GROUP BY ALL)
SELECT qf."column", qf.class, CAST(n AS BIGINT) AS n, round(q0, 6) AS q1, round(q1, 6) AS median,
       round(q2, 6) AS q3, round(iqr, 6) AS iqr, round(least(COALESCE(in_lo, q0), q0), 6) AS whisker_lo,
       round(greatest(COALESCE(in_hi, q2), q2), 6) AS whisker_hi, CAST(n_out AS BIGINT) AS n_outliers,
       round(mn, 6) AS min, round(mx, 6) AS max
FROM qf JOIN e ON qf."column" = e."column" AND qf.class = e.class""")
def q_lineitem_box_stats(spark, sf_dir):
    return explore.box_stats(table(spark, sf_dir, "lineitem"), LI_BOX_COLS, by="l_returnflag")


@query("part_index", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", value, CAST(row_number() OVER (ORDER BY cnt DESC, value) - 1 AS INTEGER) AS "index"
        FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM part WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in PART_CATS))
def q_part_index(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    idx = features.feature_stages(PART_CATS, [], use_pairwise=False)[0]
    out = Pipeline(stages=[idx]).fit(part).transform(part)
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                                         F.col(f"{c}_index").cast("int").alias("index")) for c in PART_CATS]))
    return out.select(items.alias("s")).select("s.*").distinct()


@query("part_value_counts", f"""
SELECT "column", value, count(*) AS count FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM part" for c in PART_CATS + ['p_size'])}
) WHERE value IS NOT NULL GROUP BY "column", value""")
def q_part_value_counts(spark, sf_dir):
    return distribution.value_counts(table(spark, sf_dir, "part"), PART_CATS + ["p_size"])
