"""Driver tables and the transaction view derived from ``events``.

The view maps each ``events`` row to a card transaction with plain integer arithmetic,
so the same columns can be written in any SQL engine (see FIXTURES.md section 5).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed values of the transaction view (must equal the oracle's view).
DOB_EPOCH = "1940-01-01"
AS_OF = "2024-02-01"
NIGHT_HOURS_FROM = 22
NIGHT_HOURS_TO = 4
FRAUD_AMOUNT = 200
TRAIN_DECILES = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _dob(user_id: Column) -> Column:
    offset = ((user_id * 97) % 20000).cast("int")
    return F.date_add(F.lit(DOB_EPOCH).cast("date"), offset)


def txn_view(events: DataFrame) -> DataFrame:
    """Transactions with the raw-table roles (typed), one projection over ``events``."""
    uid, eid, ts, value = F.col("user_id"), F.col("event_id"), F.col("ts"), F.col("value")
    hour = F.hour(ts)
    night = (hour >= NIGHT_HOURS_FROM) | (hour < NIGHT_HOURS_TO)
    score_milli = F.floor(F.least(F.lit(1000.0), value * 2)).cast("bigint")
    return events.select(
        eid.alias("txn_id"),
        ts.alias("trans_ts"),
        value.alias("amt"),
        F.concat(F.lit("m"), (uid % 40).cast("string")).alias("merchant"),
        F.col("event_type").alias("category"),
        F.when(uid % 2 == 0, "F").otherwise("M").alias("gender"),
        F.concat(F.lit("job_"), (uid % 12).cast("string")).alias("job"),
        (F.lit(1000) + uid * 37).alias("city_pop"),
        _dob(uid).alias("dob"),
        ((uid % 120) - 60).cast("double").alias("lat"),
        ((uid * 7 % 300) - 150).cast("double").alias("long"),
        ((eid % 120) - 60).cast("double").alias("merch_lat"),
        ((eid * 11 % 300) - 150).cast("double").alias("merch_long"),
        F.when(eid % 10 < TRAIN_DECILES, "train").otherwise("test").alias("portion"),
        ((value * F.when(night, 2).otherwise(1)) > FRAUD_AMOUNT).cast("int").alias("is_fraud"),
        score_milli.alias("score_milli"),
        (score_milli / F.lit(1000.0)).cast("double").alias("score"),
    )


def load_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn_view(table(spark, sf_dir, "events"))


# Same view in portable SQL, for DuckDB oracles.
TXN_SQL = f"""
SELECT event_id AS txn_id,
       ts AS trans_ts,
       value AS amt,
       concat('m', CAST(user_id % 40 AS VARCHAR)) AS merchant,
       event_type AS category,
       CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       concat('job_', CAST(user_id % 12 AS VARCHAR)) AS job,
       1000 + user_id * 37 AS city_pop,
       CAST(DATE '{DOB_EPOCH}' + CAST(user_id * 97 % 20000 AS INTEGER) AS DATE) AS dob,
       CAST((user_id % 120) - 60 AS DOUBLE) AS lat,
       CAST((user_id * 7 % 300) - 150 AS DOUBLE) AS long,
       CAST((event_id % 120) - 60 AS DOUBLE) AS merch_lat,
       CAST((event_id * 11 % 300) - 150 AS DOUBLE) AS merch_long,
       CASE WHEN event_id % 10 < {TRAIN_DECILES} THEN 'train' ELSE 'test' END AS portion,
       CAST(value * (CASE WHEN hour(ts) >= {NIGHT_HOURS_FROM} OR hour(ts) < {NIGHT_HOURS_TO}
                          THEN 2 ELSE 1 END) > {FRAUD_AMOUNT} AS INTEGER) AS is_fraud,
       CAST(floor(least(1000, value * 2)) AS BIGINT) AS score_milli,
       CAST(floor(least(1000, value * 2)) AS BIGINT) / 1000.0::DOUBLE AS score
FROM events
"""
