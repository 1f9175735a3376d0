"""Filter interaction audit (operator 13): what each filter of a chain adds to the others.

Five filters judge whole texts (null: empty; words are ``[^\\x20\\x09-\\x0D]+``, case-sensitive):

* A: fewer than ``min_words`` words;
* B: distinct words below ``distinct_percent`` of all words;
* C: ``[A-Z]`` characters above ``capital_percent`` of the code points;
* D: one of ``SYMBOLS`` occurs;
* E: the text equals that of a row with a smaller doc_id, whether other filters remove that row or not.

E is an existential self-join: a left-semi join on hash, exact text and smaller doc_id. Its right side is
aggregated first, inside each task, to one row a text with the least doc_id, and only texts that two ids share
go into the join, so a group of copies never meets itself. The ids that fail E are united with the ids that
the other filters fail, and their bits are summed up to one combination a document. Documents count only as
combinations from there on (at most 32 a part and label), and every order of the filters is read off those.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, query, table

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
ALL = (1 << len(FILTERS)) - 1
SYMBOLS = "#$%&*|"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text, hash), without other columns of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       text.alias("text"), F.xxhash64(text).alias("hash"))


def failing_alone(t: DataFrame, min_words: int = MIN_WORDS, distinct_percent: int = DISTINCT_PERCENT,
                  capital_percent: int = CAPITAL_PERCENT) -> DataFrame:
    """(doc_id, part, hash, bits, n = 1): what A to D say of every row, also where they say nothing."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    t = t.select("doc_id", "part", "hash", "text", words.alias("words"))
    n_words, n_distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = {
        "A": n_words < min_words,
        "B": 100 * n_distinct.cast("long") < distinct_percent * n_words.cast("long"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > capital_percent * F.length("text").cast("long"),
        "D": F.col("text").rlike(f"[{SYMBOLS}]"),
    }
    bits = sum((F.when(c, F.lit(BIT[f])).otherwise(F.lit(0)) for f, c in fails.items()), F.lit(0))
    return t.select("doc_id", "part", "hash", bits.alias("bits"), F.lit(1).cast("long").alias("n"))


def later_copies(t: DataFrame) -> DataFrame:
    """(doc_id, part, hash) of the rows whose text a smaller doc_id has too.

    A null doc_id is neither smaller nor larger than another; equal ids are not smaller."""
    first = t.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")) \
        .where("first < last").select(F.col("hash").alias("_h"), F.col("text").alias("_t"), "first")
    same = (F.col("hash") == F.col("_h")) & (F.col("text") == F.col("_t")) & (F.col("first") < F.col("doc_id"))
    return t.join(first, same, "left_semi").select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(part, bits, n, good, toxic): documents for each part and set of failed filters.

    Bits are united by (doc_id, part, hash of the text), so that rows that share a doc_id keep their own
    bits and are all counted. ``good`` and ``toxic`` count documents with a label row of quality 1 or
    toxic 1; labels without doc_id belong to none."""
    t = texts(docs)
    copies = later_copies(t).select("doc_id", "part", "hash", F.lit(BIT["E"]).alias("bits"), F.lit(0).cast("long").alias("n"))
    united = failing_alone(t, **settings).unionByName(copies) \
        .groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = labels.select(F.col("doc_id").alias("_id"), "quality", "toxic").where("_id is not null") \
        .groupBy("_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"),
                            F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    # rows without an id are spread by their text's hash and match no label
    key = F.coalesce(F.col("doc_id").cast("long"), F.col("hash"))
    known = F.col("doc_id").isNotNull() & (key == F.col("_id"))
    return united.join(marks, known, "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("_good") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("_toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))


def order_steps(spark) -> DataFrame:
    """(filter_order, step, filter, bit, before): the steps of all orders; ``before`` has the bits of
    the filters applied earlier. 600 rows, set by the number of filters."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(order), step, f, BIT[f], before))
            before |= BIT[f]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, bit int, before int")


def audit(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley, filter.

    ``part`` is the language (null counts as the empty one). ``shapley`` is what the step's filter removes,
    summed over all orders: a document that fails k filters is removed by each of them in 1/k of the orders.
    Null texts are empty: they fail A, are equal to one another, and pass B, C and D. Very long texts are used
    whole, repeated rows count as often as they occur, and a copy is one only of a smaller doc_id, so ties in
    doc_id and rows without one mark nothing. Columns other than doc_id, text and lang are ignored, whatever
    their names. An empty table gives no rows.
    """
    bits, n = F.col("bits"), F.col("n")
    cells = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(m).alias("before"))
                      for b in BIT.values() for m in range(ALL + 1) if not m & b])
    c = combinations(docs, labels, **settings).select("*", F.explode(cells).alias("s")).select("part", "bits", "n", "good", "toxic", "s.*")
    fails = bits.bitwiseAND(F.col("bit")) != 0
    gone = bits.bitwiseAND(F.col("before")) != 0
    count = lambda when, what=n: F.sum(F.when(when, what).otherwise(0)).cast("long")
    orders = 120
    sums = c.groupBy("part", "bit", "before").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(bits == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone, F.col("good")).alias("good_lost"), count(fails & ~gone, F.col("toxic")).alias("toxic_lost"),
        count(fails, n * (F.lit(orders) / F.greatest(F.bit_count("bits"), F.lit(1))).cast("long")).alias("shapley"))
    steps = order_steps(docs.sparkSession)
    return sums.join(F.broadcast(steps), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", "filter")


_SQL = """
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by text) as first from d),
b as (select doc_id, part,
        (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
        + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(first < doc_id, false)::int as bits from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, bits, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
      from b left join l using (doc_id) group by part, bits),
f(f, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select f1.f || f2.f || f3.f || f4.f || f5.f as filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] as bit
      from f f1, f f2, f f3, f f4, f f5 where f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31
        and (f1.bit | f2.bit | f3.bit | f4.bit | f5.bit) = 31),
s as (select filter_order, step::int as step, bit[step] as bit, coalesce(list_sum(bit[1:step - 1]), 0)::int as before
      from o, range(1, 6) as r(step))
select part, filter_order, step, substr(filter_order, step, 1) as filter,
  coalesce(sum(n) filter (where bits & (before | bit) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (where bits & bit <> 0 and bits & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (where bits & bit <> 0 and bits & before <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (where bits = bit), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where bits & bit <> 0 and bits & before = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (where bits & bit <> 0 and bits & before = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(bits), 1)) filter (where bits & bit <> 0), 0)::bigint as shapley
from c, s group by part, filter_order, step
"""


@query("op13_filter_audit", _SQL)
def op13_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
