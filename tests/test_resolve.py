"""The resolve job and its ordered names: every tier, a site with a third of the rows, missing values."""

import random

from pyspark.sql import functions as F

from geodemand import jobs
from geodemand.operators.rows import ordered_text


def test_ordered_text_in_many_ranges(spark):
    rng = random.Random(3)
    rows = [(1 if i % 3 == 0 else rng.randrange(2, 40), rng.randrange(0, 700), rng.choice(["a", "bb", "c c", None])) for i in range(3000)]
    rows += [(None, 1, "x"), (99, 5, None), (98, None, "last"), (98, 4, "first"), (1, 5, "a"), (1, 5, "a")]
    df = spark.createDataFrame(rows, "k int, o int, t string")
    want: dict = {}
    for k, o, t in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want.setdefault(k, []).append(t)
    want = {k: " + ".join(v) for k, v in want.items()} | {99: ""}
    for per in (40, 100_000):
        found = ordered_text(df, ["k"], "o", "t", "texts", rows_per_range=per)
        assert {r.k: r.texts for r in found.collect()} == want
    assert ordered_text(df.limit(0), ["k"], "o", "t", "texts").collect() == []


def test_a_hot_key_is_joined_in_parts_of_bounded_size(spark):
    df = spark.range(0, 4000).select(F.lit(7).alias("k"), (F.col("id") * 37 % 4000).alias("o"), F.col("id").cast("string").alias("t"))
    dealt = df.repartitionByRange(40, "o").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert dealt < 400
    found = ordered_text(df, ["k"], "o", "t", "texts", rows_per_range=100).first().texts
    assert found == " + ".join(str(i) for i in sorted(range(4000), key=lambda x: x * 37 % 4000))


SITES = [(1, "Alpha, XX", 1, 40.0, -75.0, "east"), (2, "Beta City, XX", 1, 41.0, -75.0, "east"), (3, "Gamma, XX", 2, 45.0, -90.0, "west"),
         (4, "Delta Station, XX", 2, None, None, "west"), (5, "Omega, XX", 3, 10.0, 10.0, "south")]
OBS = [(10, "Forced, XX", 2, 45.0, -90.0, 5.0),            # override to site 1, wherever it lies
       (11, "Nowhere, XX", 9, 40.0, -75.0, 1.0),            # no site in its state
       (12, "Near, XX", 1, 40.01, -75.0, 2.0),              # coordinates -> 1
       (13, "Beta City, XX", 1, 45.0, -90.0, 3.0),          # suspect: nearest lies in another state -> name -> 2
       (14, "Delta, XX", 2, 60.0, -60.0, 4.0),              # too far, by name -> 4
       (15, "Zzz, XX", 2, 60.0, -60.0, 7.0),                # unmatched
       (16, "Alpha, XX", 1, None, None, None),              # no coordinates -> name -> 1
       (17, "Gamma, XX", None, 45.0, -90.0, 8.0)]           # no state
FACTS = [(1, 9, 3, 1), (1, 8, None, 2), (3, 1, 2, 0)]


def frames(spark):
    sites = spark.createDataFrame(SITES, "site_id long, name string, state int, lat double, lon double, region string")
    obs = spark.createDataFrame(OBS, "obs_id long, raw_name string, state int, lat double, lon double, value double")
    facts = spark.createDataFrame(FACTS, "site_id long, facility_id int, rail int, bus int")
    return sites, obs, facts


def test_every_tier(spark):
    sites, obs, facts = frames(spark)
    m = {r.obs_id: (r.match_id, r.match_method) for r in jobs.resolve_observations(obs, sites, {"Forced, XX": 1}).collect()}
    assert m == {10: (1, "override"), 11: (None, "no_state_candidates"), 12: (1, "coord(1.11km)"), 13: (2, "fuzzy(100)"),
                 14: (4, "fuzzy(100)"), 15: (None, "unmatched"), 16: (1, "fuzzy(100)"), 17: (None, "no_state_candidates")}
    t = {r.site_id: r for r in jobs.resolve_sites(obs, sites, facts, {"Forced, XX": 1}, flags={"rail": "has_rail", "bus": "has_bus"}).collect()}
    assert sorted(t) == [1, 2, 3, 4, 5] and t[1].region == "east"
    assert (t[1].total_value, t[1].n_obs, t[1].obs_names, t[1].match_method) == (7.0, 3, "Forced, XX + Near, XX + Alpha, XX", "override (summed)")
    assert (t[4].lat, t[4].lon, t[4].match_method) == (60.0, -60.0, "fuzzy(100)")  # coordinates of its first observation
    assert (t[5].total_value, t[5].n_obs, t[5].obs_names, t[5].match_method, t[5].has_rail) == (None,) * 5
    assert [(t[i].has_rail, t[i].has_bus) for i in (1, 2, 3)] == [(0, 1), (None, None), (1, 0)]  # the row of the smaller facility_id
    bare = jobs.resolve_sites(obs, sites, flags={"rail": "has_rail"}).where("site_id = 1").first()
    assert (bare.n_obs, bare.has_rail) == (2, None)


def test_a_site_with_a_third_of_the_observations(spark):
    sites, _, _ = frames(spark)
    k = F.col("id")
    obs = spark.range(0, 1500).select(
        k.alias("obs_id"), F.concat(F.lit("name "), k.cast("string")).alias("raw_name"), F.when(k % 3 == 0, 1).otherwise(2).alias("state"),
        F.when(k % 3 == 0, 40.0).otherwise(45.0).alias("lat"), F.when(k % 3 == 0, -75.0).otherwise(-90.0).alias("lon"), F.lit(1.0).alias("value"))
    t = {r.site_id: r for r in jobs.resolve_sites(obs, sites, rows_per_range=50).collect()}
    assert (t[1].n_obs, t[3].n_obs, t[1].total_value) == (500, 1000, 500.0)
    assert t[1].obs_names == " + ".join(f"name {i}" for i in range(0, 1500, 3))
    assert t[3].match_method == "coord(0.00km) (summed)"


def test_empty_observations(spark):
    sites, obs, facts = frames(spark)
    t = jobs.resolve_sites(obs.limit(0), sites, facts, flags={"rail": "has_rail"}).collect()
    assert len(t) == 5 and all(r.n_obs is None and r.obs_names is None for r in t)


def test_stops_by_id_name_and_place(spark):
    entities = spark.createDataFrame([(7, "Central", 50.0, 8.0), (8, "North Park", 51.0, 8.0), (9, "South", None, None)],
                                     "entity_id long, name string, lat double, lon double")
    stops = spark.createDataFrame([(7, "whatever", 0.0, 0.0), (100, "Park North Station", 0.0, 0.0), (101, "zzz", 50.001, 8.0), (102, "zzz", 0.0, 0.0),
                                   (103, None, 51.0, 8.0), (104, "", None, None)], "stop_id long, stop_name string, stop_lat double, stop_lon double")
    m = {r.stop_id: (r.match_id, r.match_method) for r in jobs.match_stops(stops, entities).collect()}
    assert m == {7: (7, "exact_code"), 100: (8, "fuzzy_name(score=100)"), 101: (7, "coord(dist=0.11km)"), 102: (None, "unmatched"),
                 103: (8, "coord(dist=0.00km)"), 104: (None, "unmatched")}
