"""Column expressions (F1-F4, F6, F7, B7, D2 hashing).

All are native Catalyst expressions: they stay inside whole-stage codegen and never
start a Python worker. NULL in gives NULL out.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
EARTH_RADIUS_KM = 6371.0
DAYS_PER_YEAR = 365
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT = "yyyy-MM-dd"
NULL_KEY = "<null>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """A column name that may hold dots, quotes or backticks, as one identifier."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_date(c, fmt: str = DATE_FORMAT) -> Column:
    """String -> date with ``fmt`` (malformed -> NULL, even with ANSI on); dates pass through."""
    return F.try_to_date(_c(c).cast("string"), fmt)


def parse_timestamp(c, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """String -> timestamp with ``fmt`` (F2); malformed -> NULL."""
    return F.try_to_timestamp(_c(c), F.lit(fmt))


def _as_of(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, (str, _dt.date)):
        return F.lit(str(as_of)).cast("date")
    return _c(as_of)


def age_years(dob, as_of=None) -> Column:
    """Whole years from ``dob`` to ``as_of`` as ``days / 365`` truncated (F1).

    ``as_of=None`` uses ``current_date()`` (result then depends on the run date).
    """
    return (F.datediff(_as_of(as_of), _c(dob)) / F.lit(DAYS_PER_YEAR)).cast("int")


def calendar_parts(ts, prefix: str = "trans_") -> dict[str, Column]:
    """Month, hour, day of week (1 = Sunday), day of month, day of year."""
    t = _c(ts)
    return {
        f"{prefix}month": F.month(t),
        f"{prefix}hour": F.hour(t),
        f"{prefix}day_of_week": F.dayofweek(t),
        f"{prefix}day_of_month": F.dayofmonth(t),
        f"{prefix}day_of_year": F.dayofyear(t),
    }


def haversine_km(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance in km between two points given in degrees.

    ``a`` is clamped to [0, 1] so rounding can never make ``sqrt(1 - a)`` invalid.
    """
    lo1, la1, lo2, la2 = (F.radians(_c(x)) for x in (lon1, lat1, lon2, lat2))
    dlon = lo2 - lo1
    dlat = la2 - la1
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin(dlon / 2), 2)
    # Clamp with CASE, not least/greatest: those skip NULLs and would turn NULL into 0.
    a = F.when(a < 0.0, F.lit(0.0)).when(a > 1.0, F.lit(1.0)).otherwise(a)
    return F.lit(radius) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))


def ln(c) -> Column:
    """Natural log; NULL for x <= 0 and for NULL."""
    return F.log(_c(c).cast("double"))


def boxcox(c, alpha: float) -> Column:
    """Box-Cox transform (F7): ``ln(x)`` for alpha = 0, ``(x^alpha - 1) / alpha`` otherwise.

    Defined for x > 0 only; x <= 0, NULL or NaN give NULL.
    """
    x = _c(c).cast("double")
    valid = x.isNotNull() & ~F.isnan(x) & (x > 0)
    if alpha == 0:
        value = F.log(x)
    else:
        value = (F.pow(x, F.lit(float(alpha))) - F.lit(1.0)) / F.lit(float(alpha))
    return F.when(valid, value)


def above(score, threshold: float) -> Column:
    """Strict ``score > threshold`` as 0.0/1.0 (B7). NULL score -> NULL."""
    return (_c(score) > F.lit(float(threshold))).cast("double")


def hash01(key, seed: int) -> Column:
    """Deterministic uniform [0, 1) from ``(seed, key)``: first 32 bits of
    ``md5('<seed>:<key>')``. Independent of partitioning and row order; the same value
    is computable in any SQL engine with md5. A NULL key hashes as a fixed marker."""
    text = F.coalesce(_c(key).cast("string"), F.lit(NULL_KEY))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2 ** 32))


def hash01_sql(key_sql: str, seed: int) -> str:
    """DuckDB spelling of :func:`hash01`."""
    return (f"(CAST(('0x' || substr(md5('{seed}:' || COALESCE(CAST({key_sql} AS VARCHAR), '{NULL_KEY}')), 1, 8)) AS BIGINT)"
            f" / {float(2 ** 32)})")


def is_invalid(c, dtype: T.DataType | None = None) -> Column:
    """NULL, or NaN for floating columns: what an assembler with ``skip`` drops."""
    x = _c(c)
    if dtype is None or isinstance(dtype, (T.FloatType, T.DoubleType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()
