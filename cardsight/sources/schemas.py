"""Explicit schemas: no type inference on the hot path (inference costs a full extra scan)."""

from pyspark.sql import types as T

# Raw card transactions, 23 columns, CSV with header.
RAW_TRANSACTIONS = T.StructType([
    T.StructField("_c0", T.IntegerType()),
    T.StructField("trans_date_trans_time", T.StringType()),
    T.StructField("cc_num", T.LongType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("amt", T.DoubleType()),
    T.StructField("first", T.StringType()),
    T.StructField("last", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("street", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("zip", T.IntegerType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
    T.StructField("city_pop", T.IntegerType()),
    T.StructField("job", T.StringType()),
    T.StructField("dob", T.StringType()),
    T.StructField("trans_num", T.StringType()),
    T.StructField("unix_time", T.LongType()),
    T.StructField("merch_lat", T.DoubleType()),
    T.StructField("merch_long", T.DoubleType()),
    T.StructField("is_fraud", T.IntegerType()),
])

# Identifying columns the preparation step removes.
IDENTIFYING_COLUMNS = ["_c0", "cc_num", "first", "last", "street", "zip", "unix_time", "trans_num"]

# Columns removed before modelling (coordinates, location names, split tag).
NON_MODEL_COLUMNS = ["portion", "lat", "long", "merch_lat", "merch_long", "distance_km", "state", "city"]

LABEL = "is_fraud"
