"""Mixing sources to target weights by systematic sampling (operator 6).

Every source gets a target number of words: its weight's share of all words, but at most
``max_repeat`` times the words it has; what is over is shared again by weight until no
source is above its limit. Within a source the documents are put in order of size and
doc_id, each expects ``target / source words`` copies, and the running sum of these
expectations plus one random offset of the source emits a document once for each integer
that it crosses. Ordering by size lets the words taken follow the target closely.

Running sums are made in levels: sizes within a source, ranges of doc_id within a size, rows
within such a slice. Only a slice's rows meet in one window, and there are enough ranges for
a slice to stay near ``slice_rows`` rows even if one size of one source holds a third of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, query, stored, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``target`` for each row of (source, source_size): one row a source.

    Weights repeat over the sources in code point order, null last. Sources are filled in
    order of limit / weight: the first ones stop at their limit and the rest share what is
    left by weight, so one pass over the ordered sources gives the repeated resharing.
    The windows run over one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("_w", pick.cast("long")).withColumn("_cap", F.col("source_size") * max_repeat)
    fill = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = (t.withColumn("_all", F.sum("source_size").over(everything))
         .withColumn("_spent", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
         .withColumn("_rest", F.sum("_w").over(after)))
    # the water level a source would see if all before it stopped at their limits
    t = t.withColumn("_level", (F.col("_all") - F.col("_spent")).cast("double") / F.col("_rest"))
    t = t.withColumn("_stops", F.col("_w") * F.col("_level") >= F.col("_cap"))
    free = F.min(F.when(~F.col("_stops"), F.struct("_spent", "_rest"))).over(everything)
    t = t.withColumn("_free", free)
    level = (F.col("_all") - F.col("_free._spent")).cast("double") / F.col("_free._rest")
    target = F.when(F.col("_free").isNull() | F.col("_stops"), F.col("_cap").cast("double")) \
        .otherwise(F.least(F.col("_cap").cast("double"), F.col("_w") * level))
    return t.select("source", "source_size", target.alias("target"))


def offset(seed: int, source: str = "source"):
    """One offset in [0, 1) for each source, from md5 of seed and source (null: its own)."""
    text = F.concat(F.lit(f"{seed}|"), F.when(F.col(source).isNull(), F.lit("n"))
                    .otherwise(F.concat(F.lit("s"), F.col(source))))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long").cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT,
        seed: int = 7, slice_rows: int = 4_096) -> DataFrame:
    """Copies of every document that the mix takes.

    Returns doc_id, source, size, source_size, target, copies (0 if left out). Null texts
    have size 0; a null source is a source of its own; repeated rows are documents of their
    own (rows equal in source, size and doc_id are interchangeable, so any order of them
    gives the same rows); an empty table gives no rows. Other columns are ignored.
    """
    sized = stored(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    n, lo, hi = sized.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    ranges = max(1, n // (2 * slice_rows))
    span = max(1, -(-((hi or 0) - (lo or 0) + 1) // ranges))
    cut = F.floor((F.col("doc_id").cast("decimal(20,0)") - (lo or 0)) / span).cast("long")
    d = sized.withColumn("cut", F.coalesce(cut, F.lit(-1)))
    slices = d.groupBy("source", "size", "cut").agg(F.count(F.lit(1)).alias("n"))
    sizes = slices.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")),
                             weights, max_repeat).withColumn("offset", offset(seed)).withColumnRenamed("source", "_t")
    before = Window.unboundedPreceding, -1
    smaller = F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(*before))
    sizes = sizes.select(F.col("source").alias("_p"), F.col("size").alias("_q"), F.coalesce(smaller, F.lit(0)).alias("smaller")) \
        .join(targets, F.col("_p").eqNullSafe(F.col("_t"))).drop("_t")
    earlier = F.sum("n").over(Window.partitionBy("source", "size").orderBy("cut").rowsBetween(*before))
    slices = slices.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("cut").alias("_c"),
                           F.coalesce(earlier, F.lit(0)).alias("earlier")) \
        .join(sizes, F.col("_s").eqNullSafe(F.col("_p")) & (F.col("_z") == F.col("_q")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "cut").orderBy(F.col("doc_id").asc_nulls_first()))
    r = d.withColumn("rank", rank) \
        .join(slices, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
              & (F.col("cut") == F.col("_c"))) \
        .withColumn("rank", F.col("rank") + F.col("earlier") + F.col("smaller"))
    rate = F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))
    copies = F.floor(F.col("rank") * rate + F.col("offset")) - F.floor((F.col("rank") - 1) * rate + F.col("offset"))
    copies = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(copies).cast("long")
    return r.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it.

    Copies are found by (doc_id, source, size), so rows that agree in these share their copies
    evenly: they are numbered and the n-th row takes the n-th count."""
    key = ["_id", "_source", "_size", "_nth"]
    by = Window.partitionBy("_id", "_source", "_size").orderBy(F.lit(0))
    taken = mix(docs, **options).filter("copies > 0") \
        .select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    taken = taken.withColumn("_nth", F.row_number().over(by)).withColumnRenamed("copies", "_copies")
    cols = docs.columns
    d = docs.withColumns({"_id": F.col("doc_id"), "_source": F.col("source"), "_size": word_count()}) \
        .withColumn("_nth", F.row_number().over(by))
    t = taken.select(*[F.col(k).alias(f"t{k}") for k in key], "_copies")
    hit = F.col("_id").eqNullSafe(F.col("t_id")) & F.col("_source").eqNullSafe(F.col("t_source")) \
        & (F.col("_size") == F.col("t_size")) & (F.col("_nth") == F.col("t_nth"))
    return d.join(t, hit).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))) \
        .select(*cols)


_SQL = """
with d as (select doc_id, source,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
t as (select source, sum(size)::bigint as source_size,
        [5, 2, 1][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::bigint as w
      from d group by source),
f as (select *, source_size * 3 as cap, sum(source_size) over () as total,
        coalesce(sum(source_size * 3) over (order by (source_size * 3) / w, source nulls last
                 rows between unbounded preceding and 1 preceding), 0) as spent,
        sum(w) over (order by (source_size * 3) / w, source nulls last
                 rows between current row and unbounded following) as rest from t),
g as (select *, w * ((total - spent)::double / rest::double) >= cap as stops from f),
h as (select *, min(case when not stops then {'s': spent, 'r': rest} end) over () as free from g),
k as (select source, source_size, case when free is null or stops then cap::double
        else least(cap::double, w * ((total - free.s)::double / free.r::double)) end as target,
        ('0x' || substr(md5('7|' || case when source is null then 'n' else 's' || source end), 1, 12))::bigint::double
          / 281474976710656.0::double as u from h),
r as (select doc_id, source, size, row_number() over (partition by source order by size, doc_id nulls first) as rank from d),
m as (select r.doc_id, r.source, r.size, k.source_size, k.target, k.u, r.rank, least(k.target / k.source_size, 3.0::double) as rate
      from r join k on r.source is not distinct from k.source),
c as (select *, case when source_size = 0 then 0
        else floor(rank * rate + u) - floor((rank - 1) * rate + u) end::bigint as copies from m)
select doc_id, size, source_size, target, copies * size as taken, source, copies from c
"""


@query("op6_mixing", _SQL)
def op6_mixing(spark, sf_dir):
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                    "source", "copies")
