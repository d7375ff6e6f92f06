"""Composite jobs without an optional source give NULL (or 0 where a count of nothing is meant) and keep every row."""

from geodemand import jobs
from geodemand.plans.fixtures import Fixtures


def test_absent_sources(spark, sf_small):
    fx = Fixtures(spark, sf_small)
    sites = fx.sites()
    n = sites.count()
    t = jobs.spatial_features(sites, None).collect()
    assert len(t) == n and all(r.metro_pop is None and r.distance_to_nearest_major_km is None and r.num_sites_nearby >= 0 for r in t)
    t = jobs.weight_features(sites, None).collect()
    assert len(t) == n and all(r.weight_within_15km == 0 for r in t)
    t = jobs.area_features(sites, None, None).collect()
    assert len(t) == n and all(r.area_fips is None for r in t)
    t = jobs.visitor_features(sites, sites.selectExpr("site_id", "'x' as area_code"), None).collect()
    assert len(t) == n and all(r.visitors is None for r in t)
    entities = sites.selectExpr("site_id as entity_id")
    t = jobs.schedule_features(entities, entities, None, None, None, {"weekly_departures": "sum"}).collect()
    assert len(t) == n and all(r.weekly_departures is None for r in t)
    cand = sites.selectExpr("name as code", "lat", "lon")
    t = jobs.candidate_features(cand, fx.places(), sites, None, None, ("has_rail",)).collect()
    assert len(t) == n and all(r.area_fips is None and r.has_rail == 0 for r in t)


def test_defaults_of_a_column_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, kind string")
    t = jobs.feature_defaults(df, flags=("f",), zeros=("z",), missing=("m",), categories={"kind": "unknown"}, target="absent").collect()
    assert [(r.f, r.z, r.m, r.kind) for r in t] == [(0, 0.0, None, "unknown")] * 2 and "log_target" not in t[0].asDict()
