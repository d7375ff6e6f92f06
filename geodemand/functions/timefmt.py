"""Time-of-day text that may run past 24 h, as seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hhmmss_to_seconds(c) -> Column:
    """'HH:MM:SS' -> seconds since service-day start; hours may exceed 24. Malformed text -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, ":")
    h = F.element_at(parts, 1).try_cast("int")
    m = F.element_at(parts, 2).try_cast("int")
    s = F.element_at(parts, 3).try_cast("int")
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)


def hhmmss_sql(expr: str) -> str:
    return (f"(cast(split_part({expr}, ':', 1) as int)*3600 + cast(split_part({expr}, ':', 2) as int)*60"
            f" + cast(split_part({expr}, ':', 3) as int))")
