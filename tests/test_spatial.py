"""Cell-grid spatial joins equal brute force, including near the poles and across the antimeridian."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geodemand.operators import spatial as SP


def hav(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    dp, dl = p2 - p1, math.radians(d) - math.radians(b)
    x = math.sin(dp / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 6371.0 * 2 * math.asin(math.sqrt(min(max(x, 0.0), 1.0)))


def points(rnd, n, start):
    out = []
    for i in range(n):
        zone = rnd.random()
        if zone < 0.3:
            lat, lon = rnd.uniform(85, 90), rnd.uniform(-180, 180)          # north pole cap
        elif zone < 0.6:
            lat, lon = rnd.uniform(-10, 10), rnd.choice([-1, 1]) * rnd.uniform(178, 180)  # antimeridian
        else:
            lat, lon = rnd.uniform(-60, 60), rnd.uniform(-180, 180)
        out.append((start + i, lat, lon))
    return out


@pytest.mark.parametrize("radius", [50.0, 300.0])
def test_radius_join_equals_brute_force(spark, radius):
    rnd = random.Random(int(radius))
    L = points(rnd, 300, 0)
    R = points(rnd, 500, 10000)
    ldf = spark.createDataFrame(L, "lid long, lat double, lon double")
    rdf = spark.createDataFrame(R, "rid long, r_lat double, r_lon double")
    got = {(r.lid, r.rid) for r in SP.radius_join(ldf, rdf, radius).select("lid", "rid").collect()}
    exp = {(a, b) for a, la, lo in L for b, ra, ro in R if hav(la, lo, ra, ro) <= radius}
    assert got == exp and len(exp) > 0


def test_nearest_unbounded_equals_brute_force(spark):
    rnd = random.Random(5)
    L = points(rnd, 200, 0) + [(999, None, None)]
    R = [(10000 + i, rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for i in range(15)]
    ldf = spark.createDataFrame(L, "lid long, lat double, lon double")
    rdf = spark.createDataFrame(R, "rid long, r_lat double, r_lon double")
    got = {r.lid: r.rid for r in SP.nearest_unbounded(ldf, rdf, left_id="lid", right_id="rid").collect()}
    exp = {a: min(R, key=lambda r: (hav(la, lo, r[1], r[2]), r[0]))[0] for a, la, lo in L if la is not None}
    assert got == exp


def test_radius_count_nulls_and_twins(spark):
    rows = [(1, 40.0, -80.0), (2, 40.0, -80.0), (3, 40.1, -80.0), (4, None, None), (5, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    r = df.select("id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    got = {x.id: x.n for x in SP.radius_count(df, r, 20.0, left_id="id", out="n", exclude_self=True).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: None, 5: 0}


def test_empty_right_side(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0)], "id long, lat double, lon double")
    empty = spark.createDataFrame([], "rid long, r_lat double, r_lon double")
    out = SP.nearest_distance(df, empty, left_id="id", right_id="rid", out="d").collect()
    assert out[0]["d"] is None


def test_max_with_fallback(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lon double")
    right = spark.createDataFrame([(1, 0.0, 0.3, 10), (2, 0.0, 0.8, 99)], "pid long, r_lat double, r_lon double, pop long")
    got = SP.radius_max_with_fallback(left, right, "pop", left_id="id").first()["metro_pop"]
    assert got == 10          # 33 km inside 50; the larger one at 89 km only counts as fallback
    right2 = right.where("pid = 2")
    assert SP.radius_max_with_fallback(left, right2, "pop", left_id="id").first()["metro_pop"] == 99


def test_rollup_dense_cluster_equals_brute_force(spark):
    rnd = random.Random(9)
    # a dense cluster (many points within ~1 km) plus scattered points on a ring around it
    R = [(i, 45.0 + rnd.uniform(-0.005, 0.005), 7.0 + rnd.uniform(-0.005, 0.005), rnd.randint(0, 9))
         for i in range(2000)]
    R += [(5000 + i, 45.0 + rnd.uniform(-0.5, 0.5), 7.0 + rnd.uniform(-0.7, 0.7), rnd.randint(0, 9))
          for i in range(400)]
    L = [(i, la, lo) for i, la, lo, _ in R[::7]] + [(99999, 45.3, 7.3)]
    ldf = spark.createDataFrame(L, "lid long, lat double, lon double")
    rdf = spark.createDataFrame(R, "rid long, r_lat double, r_lon double, w long")
    for radius in (0.5, 30.0):
        got = {r.lid: (r.n, r.s, r.m) for r in SP.radius_rollup(
            ldf, rdf, radius, left_id="lid",
            measures={"n": ("count", None), "s": ("sum", "w"), "m": ("max", "w")}).collect()}
        exp = {}
        for a, la, lo in L:
            hits = [w for _, ra, ro, w in R if hav(la, lo, ra, ro) <= radius]
            if hits:
                exp[a] = (len(hits), sum(hits), max(hits))
        assert got == exp


def test_rollup_several_radii_one_pass(spark):
    rnd = random.Random(21)
    R = [(i, 45.0 + rnd.uniform(-0.6, 0.6), 7.0 + rnd.uniform(-0.8, 0.8), rnd.randint(0, 9)) for i in range(600)]
    L = [(i, 45.0 + rnd.uniform(-0.5, 0.5), 7.0 + rnd.uniform(-0.5, 0.5)) for i in range(80)]
    ldf = spark.createDataFrame(L, "lid long, lat double, lon double")
    rdf = spark.createDataFrame(R, "rid long, r_lat double, r_lon double, w long")
    radii = [5.0, 15.0, 40.0]
    got = {r.lid: tuple(r[f"s__r{i}"] for i in range(3)) for r in SP.radius_rollup(
        ldf, rdf, radii, left_id="lid", measures={"s": ("sum", "w")}).collect()}
    for a, la, lo in L:
        exp = []
        for rad in radii:
            hits = [w for _, ra, ro, w in R if hav(la, lo, ra, ro) <= rad]
            exp.append(sum(hits) if hits else None)
        assert got.get(a, (None, None, None)) == tuple(exp)


def _examined(spark, monkeypatch):
    """Rows of every join of points with cells, or of cells with what they hold, from here on."""
    seen, frame = [], type(spark.range(0))
    join = frame.join

    def counted(self, other, *args, **kw):
        out = join(self, other, *args, **kw)
        if {"_cx", "_cy", "_cz"} <= set(other.columns):
            out = out.cache()
            seen.append(out.count())
        return out

    monkeypatch.setattr(frame, "join", counted)
    return seen


def test_cut_dense_cells_open_few_points(spark, monkeypatch):
    rnd = random.Random(2)
    R = [(i, 45.0 + rnd.uniform(-0.2, 0.2), 7.0 + rnd.uniform(-0.3, 0.3), 1) for i in range(20_000)]
    L = [(i, 45.0 + rnd.uniform(0.6, 0.8), 7.0 + rnd.uniform(-0.2, 0.2)) for i in range(60)]  # circles that cut the cluster
    ldf = spark.createDataFrame(L, "lid long, lat double, lon double")
    rdf = spark.createDataFrame(R, "rid long, r_lat double, r_lon double, w long")
    seen = _examined(spark, monkeypatch)
    got = {r.lid: r.n for r in SP.radius_rollup(ldf, rdf, 80.0, left_id="lid", measures={"n": ("count", None)}).collect()}
    assert got == {a: n for a, la, lo in L if (n := sum(hav(la, lo, ra, ro) <= 80.0 for _, ra, ro, _ in R))}
    assert sum(seen) < 0.15 * len(L) * len(R), seen


def test_distant_dense_clusters_open_few_points(spark, monkeypatch):
    rnd = random.Random(4)
    R = [(i, 45.0 + rnd.uniform(-0.05, 0.05), 7.0 + rnd.uniform(-0.05, 0.05)) for i in range(20_000)]
    L = [(i, 45.55 + rnd.uniform(-0.01, 0.01), 7.0 + rnd.uniform(-0.01, 0.01)) for i in range(50)]  # about 60 km away
    ldf = spark.createDataFrame(L, "lid long, lat double, lon double")
    rdf = spark.createDataFrame(R, "rid long, r_lat double, r_lon double")
    want = {}
    for a, la, lo in L:
        d, b = min((hav(la, lo, ra, ro), b) for b, ra, ro in R)
        want[a] = (b, round(d, 9))
    seen = _examined(spark, monkeypatch)
    for radius in (80.0, SP.HALF_CIRCUMFERENCE_KM):
        seen.clear()
        got = {r.lid: (r.rid, round(r.dist_km, 9)) for r in SP.nearest_within(
            ldf, rdf, radius, left_id="lid", right_id="rid").collect()}
        assert got == want
        assert sum(seen) < 0.05 * len(L) * len(R), seen


def test_nearest_refines_dense_neighbourhoods(spark):
    rnd = random.Random(44)
    # 3,000 distinct points inside ~200 m, plus scattered points; tiny pair budget forces refinement
    R = [(i, 45.0 + rnd.uniform(-0.001, 0.001), 7.0 + rnd.uniform(-0.001, 0.001)) for i in range(3000)]
    R += [(9000 + i, 45.0 + rnd.uniform(-0.3, 0.3), 7.0 + rnd.uniform(-0.3, 0.3)) for i in range(200)]
    L = [(i, la, lo) for i, la, lo in R[::30]] + [(77777, 45.2, 7.2), (88888, 46.0, 8.0)]
    ldf = spark.createDataFrame(L, "lid long, lat double, lon double")
    rdf = spark.createDataFrame(R, "rid long, r_lat double, r_lon double")
    got = {r.lid: (r.rid, round(r.dist_km, 9)) for r in SP.nearest_within(
        ldf, rdf, 25.0, left_id="lid", right_id="rid").collect()}
    exp = {}
    for a, la, lo in L:
        cands = [(hav(la, lo, ra, ro), b) for b, ra, ro in R if hav(la, lo, ra, ro) <= 25.0]
        if cands:
            d, b = min(cands)
            exp[a] = (b, round(d, 9))
    assert got == exp
