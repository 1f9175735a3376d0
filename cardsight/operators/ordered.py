"""Running totals in a global order without funnelling rows into one task.

``sum(x) over (order by k)`` with no PARTITION BY moves every row to a single task, and one with a
PARTITION BY moves a whole group there. ``running_totals`` computes the same inclusive prefix sums by
a distributed sample sort, all inside one query:

1. a scalar subquery cuts the keys into a fixed number of ranges. Its sample are the rows with the
   least hashes, so it is the same however often it is computed and in whatever order rows arrive;
   the range of a row follows from its key alone, and a recomputed task puts it in the same range;
2. per-range sums (one row per range and group) -> offsets of earlier ranges with a window over that small
   table;
3. within each range a partitioned window adds the running sum to the range offset; its exchange is the
   only one for the rows themselves.

Nothing runs while the plan is built, and the sample is as large as the number of ranges asks for, whatever
the data. (Spark's own range exchange samples anew in every plan that holds it, so offsets and rows
would rest on two sets of bounds wherever the exchange is not reused.)

Input keys must be distinct within a group (aggregate first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from .joins import join_null_safe

RANGE_ID = "_range"
SAMPLES_PER_RANGE = 8


def all_columns_used(columns: list[str]) -> str:
    """A condition that holds for every row and looks at every column: several uses of an aggregate then
    need the same columns of it, and read one exchange instead of one each."""
    return f"length(CAST(xxhash64({', '.join(quoted(c) for c in columns)}) AS string)) > 0"


def cut_points(df: DataFrame, order_col: str, ranges: int) -> DataFrame:
    """One row with the sorted keys (``cuts``) between ``ranges`` ranges of about equal size (NULL keys left out).

    Taken evenly from a sample of ``SAMPLES_PER_RANGE`` keys a range, those of the rows with the least hashes."""
    sample = df.selectExpr(f"{quoted(order_col)} AS k", f"xxhash64({', '.join(quoted(c) for c in df.columns)}) AS h") \
        .orderBy("h", "k").limit(ranges * SAMPLES_PER_RANGE)      # the list below leaves NULLs out
    keys = sample.agg(F.expr("sort_array(collect_list(k)) AS ks"))
    every = f"transform(sequence(1, {ranges - 1}), i -> get(ks, CAST(floor(i * size(ks) / {ranges}) AS int)))"
    return keys.selectExpr(f"CASE WHEN size(ks) > 0 THEN array_distinct({every}) ELSE ks END AS cuts" if ranges > 1 else "slice(ks, 1, 0) AS cuts")


def range_of(key: str, ranges: int) -> str:
    """How many of ``_cuts`` lie below ``key`` (NaN is above all of them, NULL is -1), by halving steps."""
    steps = ", ".join(str(1 << b) for b in range(max(ranges - 1, 1).bit_length() - 1, -1, -1))
    place = f"aggregate(array({steps}), 0, (p, w) -> IF(p + w <= size(_cuts) AND get(_cuts, p + w - 1) < {key}, p + w, p))"
    return f"CASE WHEN {key} IS NULL THEN -1 ELSE {place} END"


def running_totals(df: DataFrame, order_col: str, value_cols: list[str], by: list[str] | None = None,
                   descending: bool = False, ranges: int | None = None,
                   suffix: str = "_cum") -> DataFrame:
    """Add ``<v><suffix>`` = sum of ``v`` over rows of the same ``by`` group whose key is
    before or equal to this row's key (``descending`` flips the order), and
    ``<v>_total`` = the group's sum (attached through the same small join).

    NULL and NaN keys and NULL groups are ordered as Spark orders them. ``ranges`` is the number of ranges
    (default: four times the session's shuffle partitions)."""
    by, key, columns = list(by or []), quoted(order_col), df.columns
    n = int(ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = cut_points(df, order_col, n).scalar()
    parted = df.where(all_columns_used(columns)).withColumn("_cuts", cuts) \
        .selectExpr(*[quoted(c) for c in columns], f"{range_of(key, n)} AS {RANGE_ID}")

    groups = ", ".join(quoted(c) for c in by)
    per_range = parted.groupBy(RANGE_ID, *[quoted(c) for c in by]).agg(*[F.expr(f"sum({quoted(v)}) AS {quoted(f'_tot_{v}')}") for v in value_cols])
    whole = f"OVER ({f'PARTITION BY {groups}' if by else ''})"
    before = (f"OVER ({f'PARTITION BY {groups}' if by else ''} ORDER BY {RANGE_ID} {'DESC' if descending else 'ASC'} "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    # one row per (range, group)
    offsets = per_range.selectExpr(
        RANGE_ID, *[quoted(c) for c in by], *[f"coalesce(sum({quoted(f'_tot_{v}')}) {before}, 0) AS {quoted(f'_off_{v}')}" for v in value_cols],
        *[f"sum({quoted(f'_tot_{v}')}) {whole} AS {quoted(f'{v}_total')}" for v in value_cols])

    within = (f"OVER (PARTITION BY {', '.join([RANGE_ID, *[quoted(c) for c in by]])} ORDER BY {key} {'DESC' if descending else 'ASC'} "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return join_null_safe(parted, offsets, [RANGE_ID, *by]).selectExpr(
        *[quoted(c) for c in columns],
        *[f"{quoted(f'_off_{v}')} + coalesce(sum({quoted(v)}) {within}, 0) AS {quoted(f'{v}{suffix}')}" for v in value_cols],
        *[quoted(f"{v}_total") for v in value_cols])
