"""Joins against derived tables. The strategy is left to adaptive execution, which
broadcasts a side only when its measured bytes are below the session's threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quoted


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (a NULL group is still a group).
    Key columns appear once in the output, as with ``join(on=[...])``."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = " AND ".join(f"{quoted(k)} <=> {quoted(f'_r_{k}')}" for k in keys)
    out = left.join(renamed, F.expr(cond), how)
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        out = out.withColumns({k: F.expr(f"coalesce({quoted(k)}, {quoted(f'_r_{k}')})") for k in keys})
    return out.drop(*[f"_r_{k}" for k in keys])


def join_static(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Broadcast join for a side whose size is fixed by parameters, not by data
    (a threshold grid, a list of columns). Callers state the bound."""
    return big.join(F.broadcast(small), on, how)
