"""Great-circle distance and unit-sphere cell keys as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in km used for every distance.
EARTH_RADIUS_KM = 6371.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in km; the inner term is clipped to [0, 1]. NULL in, NULL out."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp = p2 - p1
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    s1 = F.sin(dp / 2.0)
    s2 = F.sin(dl / 2.0)
    a = s1 * s1 + F.cos(p1) * F.cos(p2) * s2 * s2
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    # greatest/least skip NULLs, so guard explicitly: a missing coordinate gives NULL, never 0 km.
    known = _c(lat1).isNotNull() & _c(lon1).isNotNull() & _c(lat2).isNotNull() & _c(lon2).isNotNull()
    return F.when(known, F.lit(EARTH_RADIUS_KM * 2.0) * F.asin(F.sqrt(a)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The same formula as SQL text (for the DuckDB oracle)."""
    return (
        f"(case when {lat1} is null or {lon1} is null or {lat2} is null or {lon2} is null then null else "
        f"12742.0e0 * asin(sqrt(least(greatest("
        f"sin((radians({lat2}) - radians({lat1})) / 2.0e0) * sin((radians({lat2}) - radians({lat1})) / 2.0e0)"
        f" + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * sin((radians({lon2}) - radians({lon1})) / 2.0e0) * sin((radians({lon2}) - radians({lon1})) / 2.0e0)"
        f", 0.0e0), 1.0e0))) end)"
    )


def cell_side(radius_km: float) -> float:
    """Chord length of ``radius_km`` on the unit sphere, slightly widened.

    Two points within ``radius_km`` are at most this far apart in 3-D, so their
    integer cells differ by at most one step per axis.
    """
    return 2.0 * math.sin(min(radius_km, math.pi * EARTH_RADIUS_KM) / (2.0 * EARTH_RADIUS_KM)) * (1.0 + 1e-7)


def unit_xyz(lat, lon) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def cell_columns(lat, lon, side: float) -> list[Column]:
    """Integer cell of the point's unit vector on a cube grid of the given side."""
    return [F.floor(v / F.lit(side)) for v in unit_xyz(lat, lon)]


def round_to(c, digits: int) -> Column:
    """Half-up rounding to ``digits`` decimals with the same arithmetic in Spark and DuckDB.

    From 2**53 / 10**digits on a double holds no such decimals (and ``floor`` would
    leave the range of a long), so those values, NaN and infinities stay as they are.
    """
    m = float(10 ** digits)
    x = _c(c).cast("double")
    return F.when(F.abs(x) < F.lit(2.0 ** 53 / m), F.floor(x * m + 0.5) / m).otherwise(x)


def round_to_sql(expr: str, digits: int) -> str:
    """The same rounding as SQL text (for the DuckDB oracle)."""
    m = f"{10 ** digits}.0e0"
    x = f"cast({expr} as double)"
    return f"(case when abs({x}) < {2.0 ** 53 / 10 ** digits!r}e0 then floor({x}*{m} + 0.5e0)/{m} else {x} end)"


def round6(c) -> Column:
    """:func:`round_to` at 6 decimals."""
    return round_to(c, 6)
