"""Exact top-k search over binary codes by incremental multi-index hashing (operator 10).

A vector's code has one bit a dimension (1 where the value is above 0) and is cut into
segments of ``bits`` bits. The index holds each distinct code once per segment. A query
probes the segment values at radius 0, then 1, 2, ...; after radius r in all m segments
every code within distance m * (r + 1) - 1 has been met, so a query is finished when its
k-th verified distance is not above that. Codes are verified on all their bits.

Equal codes are one index entry that keeps its k smallest ids: no answer of k can use more.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import query, stored, table

SEGMENT_BITS = 16


def segments(column: str, dims: int, bits: int = SEGMENT_BITS):
    """Array of segment values; short vectors are filled up with zero bits."""
    one = F.transform(F.col(column), lambda x: F.when(x > 0, 1).otherwise(0))
    m = -(-dims // bits)
    one = F.concat(one, F.array_repeat(F.lit(0), F.lit(m * bits) - F.size(F.col(column))))
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda s: F.aggregate(
        F.slice(one, s * bits + 1, bits), F.lit(0), lambda acc, b: acc * 2 + b))


def distance(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(bits), radius)]


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, bits: int = SEGMENT_BITS,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest codes of every query by (distance, id), from all rows of ``index``.

    Returns query_id, rank (1 to k), vec_id, distance. A query row that is also in the index
    finds itself. Rows with a null id, a null or an empty vector are neither indexed nor
    answered; null elements count as 0; repeated rows are found once each; fewer than k rows
    give fewer answers; an empty table gives none. Other columns are ignored.
    """
    def clean(df, name):
        return df.select(F.col(id_col).cast("long").alias(name), F.col(vector_col).alias("_v")) \
            .filter(F.col(name).isNotNull() & (F.size("_v") > 0))

    items, asked = clean(index, "vec_id"), clean(queries, "query_id")
    dims = items.select(F.size("_v").alias("n")).unionAll(asked.select(F.size("_v").alias("n"))).agg(F.max("n")).first()[0] or 1
    m = -(-dims // bits)
    rows = items.select("vec_id", segments("_v", dims, bits).alias("code"))
    # Equal rows of one id are told apart, so that they are found once each.
    nth = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    codes = rows.withColumn("nth", nth).filter(F.col("nth") <= k) \
        .groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    codes = stored(codes, "codes")
    asked = stored(asked.select("query_id", segments("_v", dims, bits).alias("qcode")), "queries")
    entries = codes.select(F.posexplode("code").alias("seg", "val"), "code", "ids")
    best_of = Window.partitionBy("qcode").orderBy("distance", "vec_id")
    open_ = asked.select("qcode", F.lit(None).cast("int").alias("kth")).distinct()
    best, done = None, None
    for radius in range(bits + 1):
        # With kth known, radius r in segments 0 to kth - m * r covers every distance up to kth.
        wide = open_.select("qcode", "kth", F.posexplode("qcode").alias("seg", "own")) \
            .filter(F.col("kth").isNull() | (F.col("seg") <= F.col("kth") - m * radius))
        near = F.transform(F.array(*[F.lit(x) for x in masks(bits, radius)]), lambda x: x.bitwiseXOR(F.col("own")))
        probes = wide.withColumn("val", F.explode(near)) if radius <= 2 else _far(wide, entries, radius)
        probes = probes.select("qcode", "kth", F.col("seg").alias("_s"), F.col("val").alias("_v"))
        met = probes.join(entries, (F.col("seg") == F.col("_s")) & (F.col("val") == F.col("_v"))
                          & (F.col("kth").isNull() | (distance("qcode", "code") <= F.col("kth"))))
        met = met.select("qcode", "code", "ids").distinct()
        if best is not None:  # met before in another segment
            known = best.select(F.col("qcode").alias("_q"), F.col("code").alias("_c")).distinct()
            met = met.join(known, (F.col("qcode") == F.col("_q")) & (F.col("code") == F.col("_c")), "left_anti")
        found = met.select("qcode", F.explode("ids").alias("vec_id"), distance("qcode", "code").alias("distance"), "code")
        if best is not None:
            found = found.unionByName(best)
        found = found.withColumn("rank", F.row_number().over(best_of)).filter(F.col("rank") <= k).drop("rank")
        found = stored(found, f"round{radius}")
        state = found.groupBy("qcode").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        state = open_.select("qcode").join(state, "qcode", "left") \
            .select("qcode", F.when(F.col("n") >= k, F.col("far")).alias("kth"))
        covered = F.coalesce(F.col("kth") <= m * (radius + 1) - 1, F.lit(False)) if radius < bits else F.lit(True)
        state = stored(state.withColumn("finished", covered), "state")
        finished = state.filter("finished").select("qcode")
        full = found.join(finished, "qcode", "left_semi")
        done = full if done is None else done.unionByName(full)
        best = found.join(finished, "qcode", "left_anti")
        open_ = state.filter("not finished").select("qcode", "kth")
        if open_.isEmpty():
            break
    answers = done.withColumn("rank", F.row_number().over(best_of))
    return asked.join(answers, "qcode").select("query_id", F.col("rank").cast("int"), "vec_id", "distance")


def _far(wide: DataFrame, entries: DataFrame, radius: int) -> DataFrame:
    """Probes at a larger radius: the values that exist in a segment (2 ** bits at most) and
    differ from the query's in ``radius`` bits, instead of all masks."""
    values = entries.groupBy(F.col("seg").alias("_g")).agg(F.collect_set("val").alias("vals"))
    near = F.filter("vals", lambda v: F.bit_count(v.bitwiseXOR(F.col("own"))) == radius)
    return wide.join(values, F.col("seg") == F.col("_g")).select("qcode", "kth", "seg", F.explode(near).alias("val"))


_SQL = """
with e as (select vec_id, embedding, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as b
           from embeddings where vec_id is not null and len(embedding) > 0),
d as (select q.vec_id as query_id, e.vec_id, list_sum(list_transform(range(1, len(e.b) + 1), lambda i: abs(q.b[i] - e.b[i])))::int as distance
      from e q, e where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from d)
select query_id, rank, vec_id, distance from r where rank <= 10
"""


@query("op10_hamming_topk", _SQL)
def op10_hamming_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return top_k(e, e.filter("vec_id % 100 = 0"), k=10)
