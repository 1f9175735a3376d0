"""Preparation: tag, union, drop, split and derived columns.

``prepare`` is one flat projection: Catalyst collapses it into the scan's codegen stage,
no Python worker is involved and every column the caller does not select is pruned
from the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..sources import schemas


def tag(df: DataFrame, value: str, column: str = "portion") -> DataFrame:
    """Add a constant column (B1)."""
    return df.withColumn(column, F.lit(value))


def tag_union(parts: dict[str, DataFrame], column: str = "portion",
              by_position: bool = False) -> DataFrame:
    """Tag each frame with its key and union them, duplicates kept (B1 + C1).

    By name by default; ``by_position=True`` reproduces a positional union.
    """
    tagged = [tag(df, name, column) for name, df in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.union(df) if by_position else out.unionByName(df, allowMissingColumns=True)
    return out


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; names not present are ignored (B2)."""
    return df.drop(*columns)


def split_portions(df: DataFrame, column: str = "portion",
                   train: str = "train", test: str = "test") -> tuple[DataFrame, DataFrame]:
    """Equality split (B3). Filter first, drop later, so the predicate reaches the scan
    (and prunes directories when the data is partitioned by ``column``)."""
    return df.where(F.col(column) == train), df.where(F.col(column) == test)


def _is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def prepare(df: DataFrame, as_of=None, dob: str = "dob", ts: str = "trans_date_trans_time",
            drop: list[str] | None = None, lon: str = "long", lat: str = "lat",
            merch_lon: str = "merch_long", merch_lat: str = "merch_lat") -> DataFrame:
    """Raw transactions -> prepared table (F1-F4, B2, B5), one ``withColumns``.

    Adds ``age`` (whole years at ``as_of``), five calendar parts of ``ts`` and
    ``distance_km`` between card holder and merchant; drops ``dob``, ``ts`` and the
    identifying columns. String dates/timestamps are parsed (malformed -> NULL);
    typed ones are used as they are.
    """
    dob_col = scalar.as_date(dob) if _is_string(df, dob) else F.col(dob)
    ts_col = scalar.parse_timestamp(ts) if _is_string(df, ts) else F.col(ts)
    derived = {"age": scalar.age_years(dob_col, as_of)}
    derived.update(scalar.calendar_parts(ts_col))
    derived["distance_km"] = scalar.haversine_km(lon, lat, merch_lon, merch_lat)
    out = df.withColumns(derived)
    to_drop = schemas.IDENTIFYING_COLUMNS if drop is None else drop
    return out.drop(*to_drop, dob, ts)


def model_input(prepared: DataFrame, extra_drop: list[str] | None = None) -> DataFrame:
    """Prepared table minus coordinates, location names and the split tag."""
    return prepared.drop(*schemas.NON_MODEL_COLUMNS, *(extra_drop or []))
