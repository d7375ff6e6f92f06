"""Spatial joins on a unit-sphere cell grid.

Every point maps to its unit vector (x, y, z); a cube grid with side equal to
the chord of the radius puts any two points within the radius into cells that
differ by at most one step per axis. One side is replicated into its 27
neighbour cells and equi-joined on the three cell ids (plus optional block
keys), then the exact haversine distance is applied as a residual filter.
Catalyst plans this as a hash join on the cell keys -- never a nested loop --
and it has no special cases at the poles or the antimeridian.

Aggregating joins (counts, sums, maxima, flags; ``radius_rollup``) and nearest
joins (``nearest_within``) descend a pyramid of finer grids instead: cells are
taken or left by their boxes and only those that matter and hold few points
are opened, so neither a dense area nor a distant one turns into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodemand.functions.geo import EARTH_RADIUS_KM, cell_columns, cell_side, haversine_km, unit_xyz
from geodemand.operators.rows import spread

_CELLS = ("_cx", "_cy", "_cz")
_OFFSETS = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]
HALF_CIRCUMFERENCE_KM = 3.141592653589793 * EARTH_RADIUS_KM


def _with_cells(df: DataFrame, lat: str, lon: str, side: float) -> DataFrame:
    cx, cy, cz = cell_columns(lat, lon, side)
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns(
        {"_cx": cx, "_cy": cy, "_cz": cz})


def _neighbours(df: DataFrame) -> DataFrame:
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in _OFFSETS])
    return (df.withColumn("_o", F.explode(offs))
            .withColumns({"_cx": F.col("_cx") + F.col("_o.a"), "_cy": F.col("_cy") + F.col("_o.b"),
                          "_cz": F.col("_cz") + F.col("_o.c")})
            .drop("_o"))


def radius_join(left: DataFrame, right: DataFrame, radius_km: float, *,
                left_lat: str = "lat", left_lon: str = "lon", right_lat: str = "r_lat", right_lon: str = "r_lon",
                block: Sequence[tuple[str, str]] = (), replicate: str = "left",
                inclusive: bool = True) -> DataFrame:
    """All (left, right) pairs within ``radius_km`` (inclusive by default), with ``dist_km``.

    Column names of the two sides must be disjoint. ``block`` lists
    (left column, right column) pairs that must also be equal (NULL never
    matches). Rows with NULL coordinates never pair. ``replicate`` names the
    side copied into the 27 neighbour cells -- choose the smaller one.
    """
    side = cell_side(radius_km)
    lc = _with_cells(left, left_lat, left_lon, side)
    rc = _with_cells(right, right_lat, right_lon, side)
    if replicate == "left":
        lc = _neighbours(lc)
    else:
        rc = _neighbours(rc)
    lc = lc.withColumnsRenamed({c: "_l" + c for c in _CELLS})
    cond = [lc["_l" + c] == rc[c] for c in _CELLS] + [lc[a] == rc[b] for a, b in block]
    d = haversine_km(lc[left_lat], lc[left_lon], rc[right_lat], rc[right_lon])
    j = lc.join(rc, cond, "inner").withColumn("dist_km", d)
    keep = F.col("dist_km") <= radius_km if inclusive else F.col("dist_km") < radius_km
    return j.where(keep).drop(*["_l" + c for c in _CELLS], *_CELLS)


FANOUT = 4     # children of a cell on each axis
LEAF = 64      # distinct right coordinates that a nearest join compares one by one
LEAF_SUM = 256  # the same for aggregating joins, whose cut cells are the rim of a circle only
_MARGIN = 1e-9  # relative slack of the box tests; what is near a limit is compared exactly
_SMALLEST = 1e-13  # side of a cell that is opened whatever it holds: doubles do not tell its points apart
_FEW = 8  # coordinates that a cell of the first grid holds on average, at most
_HALVINGS = 24  # grids among which the first one is chosen


class _Pyramid:
    """The right side, one row per distinct (coordinate, block), on cube grids that divide by ``FANOUT`` from level to level."""

    def __init__(self, right: DataFrame, side: float, lat: str, lon: str, blocks: Sequence[str], values: dict):
        x, y, z = unit_xyz("_lat", "_lon")
        self.side = side
        self.blocks = [f"_b{i}" for i in range(len(blocks))]
        named = right.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns(
            {"_lat": F.col(lat), "_lon": F.col(lon)} | {n: F.col(b) for n, b in zip(self.blocks, blocks)})
        rows = named.groupBy("_lat", "_lon", *self.blocks).agg(*[e.alias(n) for n, e in values.items()])
        self.points = rows.withColumns({"_x": x, "_y": y, "_z": z}).checkpoint()

    def side_of(self, level: int) -> float:
        return self.side / FANOUT ** level

    def located(self, level: int) -> DataFrame:
        return self.points.withColumns({c: F.floor(F.col(p) / F.lit(self.side_of(level)))
                                        for c, p in zip(_CELLS, ("_x", "_y", "_z"))})

    def cells(self, level: int, summaries: dict) -> DataFrame:
        """Occupied cells with their number of coordinates (``_n``), the given summaries and their parents' ids."""
        c = self.located(level).groupBy(*self.blocks, *_CELLS).agg(F.count(F.lit(1)).alias("_n"),
                                                                  *[e.alias(n) for n, e in summaries.items()])
        return c.withColumns({"_p" + c_: F.floor(F.col(c_) / F.lit(FANOUT)) for c_ in _CELLS})


    def fullest(self, level: int) -> int:
        """Coordinates in the fullest cell."""
        return self.cells(level, {}).agg(F.max("_n")).first()[0] or 0

    def even_side(self) -> float:
        """Side of the coarsest of the halved grids whose occupied cells hold ``_FEW`` coordinates or fewer on average (one scan)."""
        at = lambda k: F.struct(*self.blocks, *[F.floor(F.col(p) / F.lit(self.side / 2 ** k)) for p in ("_x", "_y", "_z")])
        found = self.points.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(at(k)).alias(f"l{k}") for k in range(_HALVINGS)]).first()
        return self.side / 2 ** next((k for k in range(_HALVINGS) if found["n"] <= _FEW * found[f"l{k}"]), _HALVINGS - 1)

    def at_side(self, side: float) -> DataFrame:
        return self.points.withColumns({c: F.floor(F.col(p) / F.lit(side)) for c, p in zip(_CELLS, ("_x", "_y", "_z"))})


def _left_points(left: DataFrame, lat: str, lon: str, blocks: Sequence[str]) -> DataFrame:
    """Distinct left coordinates and blocks with their unit vectors."""
    x, y, z = unit_xyz("_llat", "_llon")
    rows = left.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(lat).alias("_llat"), F.col(lon).alias("_llon"), *[F.col(b).alias(f"_lb{i}") for i, b in enumerate(blocks)])
    return rows.distinct().withColumns({"_lx": x, "_ly": y, "_lz": z})


def _meet_cells(points: DataFrame, cells: DataFrame, side: float, n_blocks: int) -> DataFrame:
    """Left points with the occupied cells around theirs (and their box distances, squared).

    Neighbourhoods are looked up once a cell, not once a point. The points come
    in as many partitions as the session shuffles to: each grows to many rows,
    which its own size does not show.
    """
    blocks = [f"_b{i}" for i in range(n_blocks)]
    wide = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    home = [f"_h{c}" for c in _CELLS]
    here = points.withColumnsRenamed({f"_lb{i}": f"_b{i}" for i in range(n_blocks)}).withColumns(
        {h: F.floor(F.col(v) / F.lit(side)) for h, v in zip(home, ("_lx", "_ly", "_lz"))})
    around = here.select(*blocks, *home).distinct().withColumns({c: F.col(h) for c, h in zip(_CELLS, home)})
    met = _neighbours(around).join(cells, [*blocks, *_CELLS])
    return _with_gaps(here.repartition(wide).join(met, [*blocks, *home]).drop(*home), side)


def _with_gaps(met: DataFrame, side: float) -> DataFrame:
    """Least and largest squared chord from the left point to the cell's box."""
    least, most = F.lit(0.0), F.lit(0.0)
    for p, c in zip(("_lx", "_ly", "_lz"), _CELLS):
        lo, hi = F.col(c) * F.lit(side), (F.col(c) + 1) * F.lit(side)
        gap = F.greatest(lo - F.col(p), F.lit(0.0), F.col(p) - hi)
        far = F.greatest(F.abs(F.col(p) - lo), F.abs(F.col(p) - hi))
        least, most = least + gap * gap, most + far * far
    return met.withColumns({"_near": least, "_far": most})


def _descend(open_: DataFrame, pyramid: _Pyramid, level: int, summaries: dict, keep: Sequence[str]) -> DataFrame:
    """The children, at ``level``, of cells of the level above, with box distances."""
    parents = open_.select(*keep, *pyramid.blocks, *[F.col(c).alias("_p" + c) for c in _CELLS])
    children = pyramid.cells(level, summaries)
    met = parents.join(children, [*pyramid.blocks, *["_p" + c for c in _CELLS]]).drop(*["_p" + c for c in _CELLS])
    return _with_gaps(met, pyramid.side_of(level))


def _chord2(km: float) -> float:
    return (2.0 * math.sin(min(km, HALF_CIRCUMFERENCE_KM) / (2.0 * EARTH_RADIUS_KM))) ** 2


def _within(km: float) -> Column:
    """Whether the pair of points lies within the distance: by their squared chord, by the distance itself where that is near the limit."""
    limit = _chord2(km)
    return F.when(F.col("_d2") < limit * (1 - _MARGIN) - 1e-18, True).when(F.col("_d2") > limit * (1 + _MARGIN) + 1e-18, False).otherwise(
        haversine_km("_llat", "_llon", "_lat", "_lon") <= km)


_POINT = ("_llat", "_llon", "_lx", "_ly", "_lz")


def _settled_nearby(points: DataFrame, pyramid: _Pyramid, radius_km: float, best: Column, n_blocks: int) -> tuple[DataFrame, DataFrame | None]:
    """(best hits of the left points that the cells around theirs settle, the other left points or None if there are none).

    The grid is the coarsest one with few coordinates a cell on average. A hit
    nearer than a cell's side is the nearest of all, as everything else lies
    farther away. Points beside a cell of more than ``LEAF`` coordinates are left
    to the descent.
    """
    side = pyramid.even_side()
    key = ["_llat", "_llon", *pyramid.blocks]
    here = pyramid.at_side(side)
    cells = here.groupBy(*pyramid.blocks, *_CELLS).agg(F.count(F.lit(1)).alias("_n"))
    crowded = cells.where(F.col("_n") > LEAF).drop("_n")
    some_crowded = (cells.agg(F.max("_n")).first()[0] or 0) > LEAF
    around = points.withColumns({c: F.floor(F.col(v) / F.lit(side)) for c, v in zip(_CELLS, ("_lx", "_ly", "_lz"))})
    around = _neighbours(around).withColumnsRenamed({f"_lb{i}": f"_b{i}" for i in range(n_blocks)})
    at = [*pyramid.blocks, *_CELLS]
    open_ = here.join(crowded, at, "left_anti") if some_crowded else here
    near = around.select(*key, *_CELLS).join(open_.select("_lat", "_lon", "_r", *at), at)
    near = near.withColumn("dist_km", haversine_km("_llat", "_llon", "_lat", "_lon")).where(F.col("dist_km") <= radius_km)
    hits = near.groupBy(*key).agg(best)
    whole = side >= pyramid.side
    if not whole:
        hits = hits.where(F.col("_m.dist_km") < 2 * EARTH_RADIUS_KM * math.asin(min(1.0, side / 2)) * (1 - _MARGIN))
    if some_crowded:
        hits = hits.join(around.join(crowded, at, "left_semi").select(*key).distinct(), key, "left_anti")
    hits = hits.checkpoint()
    named = points.withColumnsRenamed({f"_lb{i}": f"_b{i}" for i in range(n_blocks)})
    rest = named.join(hits, key, "left_anti")
    if (whole and not some_crowded) or rest.isEmpty():
        return hits, None
    if whole:  # only what stands beside a crowded cell may still have a hit
        rest = rest.join(around.join(crowded, at, "left_semi").select(*key).distinct(), key, "left_semi")
    return hits, rest.withColumnsRenamed({f"_b{i}": f"_lb{i}" for i in range(n_blocks)})


def _nearest_by_descent(points: DataFrame, pyramid: _Pyramid, radius_km: float, n_blocks: int) -> DataFrame:
    """(left point, dist_km, _r): right coordinates among which each left point's nearest is, by descending the pyramid."""
    per_point = Window.partitionBy("_llat", "_llon", *pyramid.blocks)
    keep = [*_POINT, "_best"]
    limit = F.lit(_chord2(radius_km) * (1 + _MARGIN) + 1e-18)
    met = _meet_cells(points, pyramid.cells(0, {}), pyramid.side, n_blocks).withColumn("_best", limit)
    parts, level = [], 0
    while True:
        # no point's nearest lies beyond the farthest corner of any occupied cell
        bound = F.least(F.col("_best"), F.min("_far").over(per_point) * (1 + _MARGIN) + 1e-18)
        met = met.withColumn("_best", bound).where(F.col("_near") <= F.col("_best")).drop("_near", "_far").checkpoint()
        leaf = F.lit(pyramid.side_of(level) < _SMALLEST) | (F.col("_n") <= LEAF)
        near = met.where(leaf).select("_llat", "_llon", *pyramid.blocks, *_CELLS).join(
            pyramid.located(level).select("_lat", "_lon", "_r", *pyramid.blocks, *_CELLS), [*pyramid.blocks, *_CELLS])
        d = haversine_km("_llat", "_llon", "_lat", "_lon")
        parts.append(near.select("_llat", "_llon", *pyramid.blocks, d.alias("dist_km"), "_r").where(F.col("dist_km") <= radius_km))
        rest = met.where(~leaf)
        if rest.isEmpty():
            break
        level += 1
        met = _descend(rest, pyramid, level, {}, keep)
    return reduce(DataFrame.unionByName, parts)


def nearest_within(left: DataFrame, right: DataFrame, radius_km: float, *, left_id: str, right_id: str,
                   left_lat: str = "lat", left_lon: str = "lon", right_lat: str = "r_lat", right_lon: str = "r_lon",
                   block: Sequence[tuple[str, str]] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Per left id, the nearest right row within the radius; ties go to the smaller right id.

    Both sides are collapsed to distinct coordinates (right: the smallest id, which
    is the tie-break winner). Left coordinates that the cells around theirs settle,
    on a grid chosen by the density of the right side, are done at once
    (:func:`_settled_nearby`). Each of the others starts with the occupied cells
    around it on the grid of the radius and descends a pyramid of grids: a cell is left aside when the least
    distance to its box exceeds the radius or the largest distance to another
    occupied cell's box, and opened once it holds ``LEAF`` coordinates or fewer. A
    coordinate thus meets a few cells a level, however dense the right side is and
    wherever it lies. Returns ``left_id, right_id, dist_km`` plus ``carry`` right
    columns; left rows without a hit are absent (left-join the result back for NULLs).
    """
    lb, rb = [a for a, _ in block], [b for _, b in block]
    values = {"_r": F.min_by(F.struct(F.col(right_id).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]), F.col(right_id))}
    pyramid = _Pyramid(right, cell_side(radius_km), right_lat, right_lon, rb, values)
    points = _left_points(left, left_lat, left_lon, lb)
    best = F.min_by(F.struct("_r", "dist_km"), F.struct("dist_km", F.col("_r.id"))).alias("_m")
    settled, points = _settled_nearby(points, pyramid, radius_km, best, len(block))
    if points is not None:
        rest = _nearest_by_descent(points, pyramid, radius_km, len(block))
        settled = settled.unionByName(rest.groupBy("_llat", "_llon", *pyramid.blocks).agg(best))
    lsel = left.select(left_id, F.col(left_lat).alias("_llat"), F.col(left_lon).alias("_llon"),
                       *[F.col(a).alias(n) for a, n in zip(lb, pyramid.blocks)])
    return lsel.join(settled, ["_llat", "_llon", *pyramid.blocks]).select(
        left_id, F.col("_m._r.id").alias(right_id), F.col("_m.dist_km").alias("dist_km"),
        *[F.col(f"_m._r.c{i}").alias(c) for i, c in enumerate(carry)])


def nearest_unbounded(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str,
                      left_lat: str = "lat", left_lon: str = "lon", right_lat: str = "r_lat",
                      right_lon: str = "r_lon", carry: Sequence[str] = ()) -> DataFrame:
    """Exact nearest right row for every left row with coordinates, at any distance.

    :func:`nearest_within` half the circumference: the first grid has the whole
    sphere in a cell's neighbourhood. No rows when ``right`` has no coordinates.
    """
    return nearest_within(left, right, HALF_CIRCUMFERENCE_KM, left_id=left_id, right_id=right_id, left_lat=left_lat,
                          left_lon=left_lon, right_lat=right_lat, right_lon=right_lon, carry=carry)


_OPS = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_COMBINE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def radius_rollup(left: DataFrame, right: DataFrame, radius_km: float | Sequence[float], *, left_id: str,
                  measures: dict[str, tuple[str, str | None]], left_lat: str = "lat", left_lon: str = "lon",
                  right_lat: str = "r_lat", right_lon: str = "r_lon", block: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Decomposable aggregates (count / sum / max / min) of right rows within the radius of each left row.

    The right side is summarised per coordinate and per cell of a pyramid of
    grids. Each distinct left coordinate starts with the occupied cells around
    it: a cell inside the radius gives its summary, one outside is left aside, and
    one that the circle cuts is compared point by point if it holds ``LEAF_SUM``
    coordinates or fewer, else divided. A circle over a dense area of n points so
    meets in the order of the square root of n of them, at any size.
    ``measures``: name -> (op, right column; None for count).

    Several radii are answered in one pass (grid of the largest): output columns
    are ``<name>`` for a single radius, ``<name>__r<i>`` (i-th radius) otherwise.
    Returns ``left_id`` plus the measure columns for left rows with any hit.
    """
    multi = not isinstance(radius_km, (int, float))
    radii = [float(r) for r in (radius_km if multi else [radius_km])]
    lb, rb = [a for a, _ in block], [b for _, b in block]
    outs = {(n, i): (f"{n}__r{i}" if multi else n) for n in measures for i in range(len(radii))}
    values = {f"_m_{n}": _OPS[op](F.col(c) if c else F.lit(1)) for n, (op, c) in measures.items()}
    summaries = {f"_m_{n}": _COMBINE[op](f"_m_{n}") for n, (op, _) in measures.items()}
    pyramid = _Pyramid(right, cell_side(max(radii)), right_lat, right_lon, rb, values)
    points = _left_points(left, left_lat, left_lon, lb)
    key = ["_llat", "_llon", *pyramid.blocks]
    # per radius: is it still to be settled below this cell?
    asked = [f"_ask{i}" for i in range(len(radii))]
    met = _meet_cells(points, pyramid.cells(0, summaries), pyramid.side, len(block)).withColumns({a: F.lit(True) for a in asked})
    deep = pyramid.fullest(0) > LEAF_SUM
    parts, level = [], 0
    while True:
        inside = [F.col(a) & (F.col("_far") <= _chord2(r) * (1 - _MARGIN)) for a, r in zip(asked, radii)]
        cut = [F.col(a) & (F.col("_far") > _chord2(r) * (1 - _MARGIN)) & (F.col("_near") <= _chord2(r) * (1 + _MARGIN) + 1e-18)
               for a, r in zip(asked, radii)]
        met = met.withColumns({f"_in{i}": x for i, x in enumerate(inside)} | {f"_cut{i}": x for i, x in enumerate(cut)})
        some = [F.col(f"_in{i}") | F.col(f"_cut{i}") for i in range(len(radii))]
        met = met.where(reduce(or_, some)).drop("_near", "_far", *asked).checkpoint()
        any_in = reduce(or_, [F.col(f"_in{i}") for i in range(len(radii))])
        any_cut = reduce(or_, [F.col(f"_cut{i}") for i in range(len(radii))])
        parts.append(met.where(any_in).select(*key, *[
            F.when(F.col(f"_in{i}"), F.col(f"_m_{n}")).alias(o) for (n, i), o in outs.items()]))
        leaf = F.lit(pyramid.side_of(level) < _SMALLEST) | (F.col("_n") <= LEAF_SUM)
        open_ = met.where(any_cut & leaf).select(*key, "_lx", "_ly", "_lz", *_CELLS, *[f"_cut{i}" for i in range(len(radii))])
        open_ = spread(open_, *pyramid.blocks, *_CELLS).join(
            pyramid.located(level), [*pyramid.blocks, *_CELLS])
        chord = reduce(add, [(F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in (("_lx", "_x"), ("_ly", "_y"), ("_lz", "_z"))])
        open_ = open_.withColumn("_d2", chord).where(F.col("_d2") <= _chord2(max(radii)) * (1 + _MARGIN) + 1e-18)
        parts.append(open_.select(*key, *[
            F.when(F.col(f"_cut{i}") & _within(radii[i]), F.col(f"_m_{n}")).alias(o) for (n, i), o in outs.items()]))
        rest = met.where(any_cut & ~leaf)
        if not deep or rest.isEmpty():
            break
        level += 1
        rest = rest.withColumns({a: F.col(f"_cut{i}") for i, a in enumerate(asked)})
        met = _descend(rest, pyramid, level, summaries, [*_POINT, *asked])
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    per_point = found.groupBy(*key).agg(*[_COMBINE[measures[n][0]](o).alias(o) for (n, _), o in outs.items()])
    hit = reduce(or_, [F.col(o).isNotNull() for o in outs.values()])
    lsel = left.select(left_id, F.col(left_lat).alias("_llat"), F.col(left_lon).alias("_llon"),
                       *[F.col(a).alias(n) for a, n in zip(lb, pyramid.blocks)])
    return lsel.join(per_point.where(hit), key).select(left_id, *outs.values())


def radius_max_with_fallback(left: DataFrame, right: DataFrame, value: str, *, left_id: str,
                             radius_km: float = 50.0, fallback_km: float = 100.0, out: str = "metro_pop",
                             left_lat: str = "lat", left_lon: str = "lon", right_lat: str = "r_lat",
                             right_lon: str = "r_lon") -> DataFrame:
    """Value of the largest right row within ``radius_km``; else within ``fallback_km``; else NULL (one pass)."""
    a = radius_rollup(left, right, [radius_km, fallback_km], left_id=left_id, measures={"_v": ("max", value)},
                      left_lat=left_lat, left_lon=left_lon, right_lat=right_lat, right_lon=right_lon)
    a = a.select(left_id, F.coalesce("_v__r0", "_v__r1").alias(out))
    return left.join(a, left_id, "left")


def nearest_distance(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str,
                     out: str = "distance_km", left_lat: str = "lat", left_lon: str = "lon",
                     right_lat: str = "r_lat", right_lon: str = "r_lon") -> DataFrame:
    """Distance to the nearest right row (exact, unbounded); NULL when right is empty or coordinates missing."""
    n = nearest_unbounded(left, right, left_id=left_id, right_id=right_id, left_lat=left_lat, left_lon=left_lon,
                          right_lat=right_lat, right_lon=right_lon)
    return left.join(n.select(left_id, F.col("dist_km").alias(out)), left_id, "left")


def radius_count(left: DataFrame, right: DataFrame, radius_km: float, *, left_id: str, out: str,
                 exclude_self: bool = False, left_lat: str = "lat", left_lon: str = "lon",
                 right_lat: str = "r_lat", right_lon: str = "r_lon") -> DataFrame:
    """Number of right rows within the radius; 0 when none, NULL when the left row has no coordinates.

    ``exclude_self`` subtracts one (the left row finds itself when right is the
    same table); co-located twins are still counted.
    """
    a = radius_rollup(left, right, radius_km, left_id=left_id, measures={"_cnt": ("count", None)},
                      left_lat=left_lat, left_lon=left_lon, right_lat=right_lat, right_lon=right_lon)
    j = left.join(a, left_id, "left")
    has = F.col(left_lat).isNotNull() & F.col(left_lon).isNotNull()
    cnt = F.coalesce(F.col("_cnt"), F.lit(0)) - (1 if exclude_self else 0)
    return j.withColumn(out, F.when(has, cnt).cast("bigint")).drop("_cnt")


def radius_sum_multi(left: DataFrame, right: DataFrame, weight: str, radii: Sequence[float], *, left_id: str,
                     prefix: str = "weight_within_", left_lat: str = "lat", left_lon: str = "lon",
                     right_lat: str = "r_lat", right_lon: str = "r_lon") -> DataFrame:
    """Sum of ``weight`` within each radius (one pass for all radii); 0 when none in range."""
    a = radius_rollup(left, right, list(radii), left_id=left_id, measures={"_w": ("sum", weight)},
                      left_lat=left_lat, left_lon=left_lon, right_lat=right_lat, right_lon=right_lon)
    names = {f"_w__r{i}": f"{prefix}{int(r) if float(r).is_integer() else r}km" for i, r in enumerate(radii)}
    j = left.join(a.withColumnsRenamed(names), left_id, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names.values()})


def radius_flags(left: DataFrame, right: DataFrame, flags: Sequence[str], radius_km: float, *, left_id: str,
                 count_col: str = "n_flags", left_lat: str = "lat", left_lon: str = "lon",
                 right_lat: str = "r_lat", right_lon: str = "r_lon") -> DataFrame:
    """Any-flag within the radius per flag column (max of 0/1, 0 when none) plus how many flags are set."""
    a = radius_rollup(left, right, radius_km, left_id=left_id, measures={f: ("max", f) for f in flags},
                      left_lat=left_lat, left_lon=left_lon, right_lat=right_lat, right_lon=right_lon)
    j = left.join(a, left_id, "left").withColumns({f: F.coalesce(F.col(f), F.lit(0)).cast("int") for f in flags})
    total = F.lit(0)
    for f in flags:
        total = total + F.col(f)
    return j.withColumn(count_col, total.cast("int"))
