"""Counts and distributions.

Each is one aggregation with map-side partial aggregation, so only (group, count) pairs
cross the shuffle, whatever the input size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_count(df: DataFrame, *cols: str) -> DataFrame:
    """``groupBy(cols).count()``."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def class_distribution(df: DataFrame, column: str, digits: int = 9) -> DataFrame:
    """Count and share of each value of ``column`` in one query.

    The total is a scalar subquery over the per-value counts, evaluated once and used as
    a constant: no join, and no single task ever holds all the per-value rows, even
    for a high-cardinality column. The subquery reuses the counts exchange, so the data
    is scanned once.
    """
    counts = group_count(df, column)
    total = counts.select(F.sum("count")).scalar()
    return counts.withColumn("proportion", F.round(F.col("count") / total, digits))


def long_form(df: DataFrame, columns: list[str], name_col: str = "column",
              value_col: str = "value") -> DataFrame:
    """Columns -> (column, value-as-string) rows with one ``stack`` (no union of scans)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) AS (`{name_col}`, `{value_col}`)")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Frequency of each non-NULL value of each listed column, all columns in one job.

    Output (column, value, count), most frequent first within each column. The order is
    a range-partitioned global sort, so no column's values are funnelled into one task.
    """
    long = long_form(df.select(*columns), columns).where(F.col("value").isNotNull())
    return group_count(long, "column", "value").orderBy("column", F.desc("count"), "value")


def _reduced(values: pa.Array, counts: np.ndarray, capacity: int) -> tuple[pa.Array, np.ndarray, int]:
    """Misra-Gries: with more than ``capacity`` counters, all lose the (capacity + 1)-th largest count and
    those that reach zero go. Returns what a value may have lost."""
    if len(counts) <= capacity:
        return values, counts, 0
    loss = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > loss
    return values.filter(pa.array(left)), counts[left] - loss, loss


def _summaries(columns: list[str], capacity: int):
    """The function that summarises every column of one task: (column, value, low) with counts that are at
    most the true ones, and a row without value that says by how much at most, for any value."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: (pa.array([], pa.large_string()), np.zeros(0, np.int64)) for c in columns}
        lost = dict.fromkeys(columns, 0)
        for batch in batches:
            for i, c in enumerate(columns):
                seen = pc.value_counts(batch.column(i).drop_null().cast(pa.large_string()))
                values, counts = seen.field("values"), seen.field("counts").to_numpy()
                known, low = held[c]
                both = pa.table({"v": pa.concat_arrays([known, values]), "n": np.concatenate((low, counts))}).group_by("v").aggregate([("n", "sum")])
                *held[c], loss = _reduced(both["v"].combine_chunks(), both["n_sum"].to_numpy(), capacity)
                lost[c] += loss
        for c in columns:
            values, counts = held[c]
            yield pa.RecordBatch.from_arrays([pa.array([c] * (len(counts) + 1)), pa.concat_arrays([values, pa.nulls(1, pa.large_string())]).cast(pa.string()),
                                              pa.array(np.append(counts, lost[c]))], names=["column", "value", "low"])
    return summarise


def top_values(df: DataFrame, columns: list[str], n: int, capacity: int | None = None) -> DataFrame:
    """The ``n`` most frequent non-NULL values of each listed column, exactly: (column, value, count), in order of
    count falling and value (E3).

    Every task keeps a Misra-Gries summary of ``capacity`` counters a column (default 16 n, 256 at least), the
    summaries are merged, and the ``capacity`` values left are counted again in a second pass. A value that is
    not among them occurs at most as often as the summaries lost; if the n-th count is larger, the counts prove
    themselves, and only a bounded number of rows was shuffled. A column that proves nothing (an identifier,
    whose values occur about equally often) is grouped by value instead, each task keeping its own first ``n``.
    """
    m = capacity or max(256, 16 * n)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    merged = text.mapInArrow(_summaries(columns, m), "column string, value string, low long") \
        .groupBy("column", "value").agg(F.sum("low").alias("low"))
    rank = F.row_number().over(Window.partitionBy("column", F.col("value").isNull()).orderBy(F.desc("low"), "value"))
    rows = merged.withColumn("r", rank).where(F.col("r") <= m + 1).collect()    # capacity + 2 rows a column
    bound, kept = dict.fromkeys(columns, 0), []
    for r in rows:
        if r.value is None or r.r == m + 1:
            bound[r.column] += r.low
        else:
            kept.append((r.column, r.value))
    spark = df.sparkSession
    long = long_form(text, columns).where(F.col("value").isNotNull())
    first = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    survivors = spark.createDataFrame(kept, "column string, value string")       # at most capacity rows a column
    counted = group_count(long.join(F.broadcast(survivors), ["column", "value"]), "column", "value") \
        .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).collect()
    found = {c: [r for r in counted if r.column == c] for c in columns}
    open_ = [c for c in columns if bound[c] > 0 and (len(found[c]) < n or min(r["count"] for r in found[c]) <= bound[c])]
    out = spark.createDataFrame([(r.column, r.value, r["count"]) for c in columns if c not in open_ for r in found[c]],
                                "column string, value string, count long")
    if open_:
        grouped = group_count(long_form(text.select(*open_), open_).where(F.col("value").isNotNull()), "column", "value")
        out = out.unionByName(grouped.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).drop("_r"))
    return out.orderBy("column", F.desc("count"), "value")
