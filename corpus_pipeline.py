"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
what it returns is written as Parquet and read again as the next stage's ``docs``. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsight.llm import decontaminate, jaccardjoin, labelled, linededup, mixing, toxicity
from cardsight.llm.blocks import rest_of
from cardsight.llm.common import WORD, collected, delete, stored, table

_left: list[str] = []   # tables of the stage before, whose result has been written by now


def stage(fn):
    """A stage first removes what the stage before left in the shared folder."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _left)
        with collected(_left):
            return fn(spark, docs, sf_dir)
    return run_stage


@stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the factorization machine rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~labelled.held_out(4, 2))
    return toxicity.reject(docs, model)


@stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: later similar lines go, and so do documents that lose all their words that way: nothing in
    them is new. The others stay, with n_chars of what is left, also those that had no words before. Null texts
    become empty; repeated rows and rows that share a doc_id or have none are documents of their own."""
    out = linededup.dedup(docs, keep=rest_of(docs))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD)
    out = out.where(~emptied).drop("n_lines", "n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near duplicates stays."""
    return jaccardjoin.representatives(docs)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that contain a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: how often the mix takes each document (0 where it is left out)."""
    out = mixing.mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                      "source", "copies")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mix_stage),
]

ORACLE_SQL = None  # learned scores and similarity joins: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
