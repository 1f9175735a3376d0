"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs); root is the smallest node reachable.

    Both steps are one aggregate with partial sums and one join, so a hub with many links is
    combined before it moves. The table of each round is written and read again."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, mark = stored(edges, "links"), None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u goes to the least node around u
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionAll(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small, "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
