"""Secret scan with a random forest against false findings (operator 4, DataFrame functions only).

Candidates are runs of at least ``MIN_LENGTH`` token characters in any word of any text. Each
gets features of five kinds: its length and mix of characters, its character transitions
(changes between letters, digits and cases, vowels and consonants), the share of it that
dictionary words cover, marks of paths and addresses, and the words next to it. A Spark ML random
forest trained on labelled findings scores every candidate.

The dictionary is made of the commonest short words of all documents. The given tables hold
no labelled findings, so the query labels candidates by where they stand: a value in quotes that
is assigned to a name like token, key or password is a true finding, any other candidate is a
false one. Labelled findings of another origin (doc_id, place, part, label) can be passed instead.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, stored, table

MIN_LENGTH = 16
TOKEN = r"[A-Za-z0-9+/_=\-]{%d,}" % MIN_LENGTH
SPACES = r"[\x20\x09-\x0D]+"
NAMES = r"(?i)(token|secret|passw|pwd|api[_-]?key|auth|credential|bearer|key)"
PER_CLASS = 5_000
DICTIONARY = 300
CUT = 0.5

NUMERIC = ["length", "digits", "uppers", "lowers", "marks", "kinds", "hex", "case_steps", "digit_steps", "vowel_steps",
           "longest_letters", "dictionary", "slashes", "dots", "address", "quoted", "assigned", "named"]
NEIGHBOURS = ["before_2", "before_1", "after_1"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, place, part, candidate, word, before_2, before_1, after_1): place is the word's number
    in the text and part the candidate's number in the word."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split("text", SPACES).alias("w")) \
        .filter(F.col("w").isNotNull())
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).rlike(TOKEN))
    seen = F.transform(places, lambda i: F.struct(
        i.alias("place"), F.get("w", i).alias("word"), F.coalesce(F.get("w", i - 2), F.lit("")).alias("before_2"),
        F.coalesce(F.get("w", i - 1), F.lit("")).alias("before_1"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("after_1")))
    rows = words.select("doc_id", F.explode(seen).alias("s")).select("doc_id", "s.*")
    return rows.select("doc_id", "place", "word", "before_2", "before_1", "after_1",
                       F.posexplode(F.regexp_extract_all("word", F.lit(f"({TOKEN})"), F.lit(1))).alias("part", "candidate"))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The commonest words of three to eight letters a to z over all documents, commonest first."""
    w = docs.select(F.explode(F.split(F.lower("text"), SPACES)).alias("w")).filter(F.col("w").rlike("^[a-z]{3,8}$"))
    return [r.w for r in w.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def features(found: DataFrame, common: list[str]) -> DataFrame:
    c = F.col("candidate")
    n = F.length(c).cast("double")
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    covered = F.lit(0.0)
    if common:
        longest_first = "|".join(sorted(common, key=lambda w: (-len(w), w)))
        covered = 1 - F.length(F.regexp_replace(F.lower(c), longest_first, "")) / n
    near = F.concat_ws(" ", "before_2", "before_1", "word")
    longest = F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda x: F.length(x)))
    return found.withColumns({
        "length": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"),
        "marks": share(r"[+/_=\-]"), "kinds": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "case_steps": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"), "digit_steps": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "vowel_steps": share("(?i)[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])"),
        "longest_letters": longest.cast("double"), "dictionary": covered,
        "slashes": F.regexp_count("word", F.lit(r"[/\\]")).cast("double"),
        "dots": F.regexp_count("word", F.lit(r"\.")).cast("double"),
        "address": near.rlike(r"(?i)(://|www\.|@)").cast("double"),
        "quoted": F.col("word").rlike("[\"']").cast("double"), "assigned": near.rlike("[=:]").cast("double"),
        "named": near.rlike(NAMES).cast("double")})


def by_place(found: DataFrame) -> DataFrame:
    """Labels from where candidates stand (see the module's text)."""
    value = F.col("word").rlike("[\"']") & F.concat_ws(" ", "before_1", "word").rlike("[=:]") \
        & F.concat_ws(" ", "before_2", "before_1", "word").rlike(NAMES)
    return found.withColumn("label", (value & F.col("candidate").rlike("[0-9]")).cast("double"))


def train(labelled: DataFrame, per_class: int = PER_CLASS, trees: int = 24, depth: int = 8, seed: int = 11) -> PipelineModel | None:
    """A forest on at most ``per_class`` findings of each label, picked by a hash of their place;
    None if only one label exists."""
    order = [F.xxhash64("doc_id", "place", "part"), "doc_id", "place", "part"]
    first = [labelled.filter(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0.0, 1.0)]
    picked = first[0].unionAll(first[1])
    picked = stored(picked.select("label", *NUMERIC, *NEIGHBOURS), "findings")
    if picked.select("label").distinct().count() < 2:
        return None
    return Pipeline(stages=[
        FeatureHasher(inputCols=NEIGHBOURS, outputCol="near", numFeatures=32),
        VectorAssembler(inputCols=[*NUMERIC, "near"], outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)]).fit(picked)


def scan(docs: DataFrame, findings: DataFrame | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """Every candidate of every text with its score (probability of a true finding).

    Returns doc_id, place, part, length, sha256 of the candidate, score, predicted (score of 0.5 or
    more). Null and empty texts have no candidates; very long texts and candidates are used
    whole; repeated rows give repeated rows; an empty table, or findings of one label only,
    give score null and predicted 0; other columns are ignored.
    """
    found = stored(features(candidates(docs), dictionary(docs)), "candidates")
    if findings is None:
        labelled = by_place(found)
    else:
        key = ["doc_id", "place", "part"]
        labelled = found.join(findings.select(*key, F.col("label").cast("double").alias("label")).dropDuplicates(key), key)
    model = train(labelled, per_class)
    scored = found.withColumn("score", F.lit(None).cast("double")) if model is None else \
        model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "place", "part", F.col("length").cast("int").alias("length"),
                         F.sha2("candidate", 256).alias("sha256"), "score",
                         (F.coalesce(F.col("score"), F.lit(0.0)) >= CUT).cast("int").alias("predicted"))


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
