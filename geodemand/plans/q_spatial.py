"""Spatial enrichment and coordinate matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand.functions.geo import haversine_sql, round6
from geodemand.operators import spatial as SP
from geodemand.operators.rows import keep_first
from geodemand.plans.fixture_sql import r6, with_fx
from geodemand.plans.fixtures import Fixtures
from geodemand.plans.registry import query

H = haversine_sql
MAJOR_POP = 500000
TOP_N_CANDIDATES = 100


def _right(df, id_col, *carry):
    return df.select(id_col, F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), *carry)


@query("radius_max_with_fallback", with_fx(f"""
select site_id, coalesce(max(case when d <= 50.0e0 then pop end), max(pop)) as metro_pop
from (select s.site_id, p.pop, {H('s.lat', 's.lon', 'p.lat', 'p.lon')} as d
      from fx_sites s left join fx_places p on {H('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 100.0e0) x
group by site_id
"""))
def radius_max_with_fallback(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    r = SP.radius_max_with_fallback(fx.sites().select("site_id", "lat", "lon"), _right(fx.places(), "place_id", "pop"),
                                    "pop", left_id="site_id", radius_km=50.0, fallback_km=100.0)
    return r.select("site_id", "metro_pop")


@query("nearest_qualifying_distance", with_fx(f"""
select s.site_id, {r6('min(' + H('s.lat', 's.lon', 'p.lat', 'p.lon') + ')')} as distance_to_nearest_major_km
from fx_sites s left join (select * from fx_places where pop > {MAJOR_POP}) p on true
group by s.site_id
"""))
def nearest_qualifying_distance(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    major = fx.places().where(F.col("pop") > MAJOR_POP)
    r = SP.nearest_distance(fx.sites().select("site_id", "lat", "lon"), _right(major, "place_id"),
                            left_id="site_id", right_id="place_id", out="d")
    return r.select("site_id", round6("d").alias("distance_to_nearest_major_km"))


@query("radius_self_count", with_fx(f"""
select a.obs_id, case when a.lat is null or a.lon is null then null else cast(count(b.obs_id) - 1 as bigint) end
  as n_within_80km
from fx_obs_gaps a left join fx_obs_gaps b
  on a.lat is not null and a.lon is not null and b.lat is not null and b.lon is not null
  and {H('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 80.0e0
group by a.obs_id, a.lat, a.lon
"""))
def radius_self_count(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    o = fx.obs_gaps().select("obs_id", "lat", "lon")
    r = SP.radius_count(o, _right(o, "obs_id"), 80.0, left_id="obs_id", out="n_within_80km", exclude_self=True)
    return r.select("obs_id", "n_within_80km")


@query("radius_sum_multi", with_fx(f"""
select s.site_id,
  cast(coalesce(sum(case when {H('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 15.0e0 then p.pop else 0 end), 0) as bigint)
    as weight_within_15km,
  cast(coalesce(sum(case when {H('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 50.0e0 then p.pop else 0 end), 0) as bigint)
    as weight_within_50km
from fx_sites s left join fx_places p on {H('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 50.0e0
group by s.site_id
"""))
def radius_sum_multi(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    r = SP.radius_sum_multi(fx.sites().select("site_id", "lat", "lon"), _right(fx.places(), "place_id", "pop"), "pop",
                            [15, 50], left_id="site_id")
    return r.select("site_id", F.col("weight_within_15km").cast("bigint").alias("weight_within_15km"),
                    F.col("weight_within_50km").cast("bigint").alias("weight_within_50km"))


def _facility_flags(fac):
    def coded(c):
        return F.when(F.col(c).isin(1, 2), 1).otherwise(0).cast("int")
    f = fac.select("facility_id", "lat", "lon", coded("rail_code").alias("has_rail"), coded("bus_code").alias("has_bus"),
                   coded("air_code").alias("has_air"),
                   F.when(F.col("class_code") == 1, 1).otherwise(0).cast("int").alias("is_metro_area"))
    return f.withColumn("modes_served", (F.col("has_rail") + F.col("has_bus") + F.col("has_air")).cast("int"))


_FLAGS_SQL = """
flags AS (select facility_id, lat, lon,
  case when rail_code in (1, 2) then 1 else 0 end as has_rail, case when bus_code in (1, 2) then 1 else 0 end as has_bus,
  case when air_code in (1, 2) then 1 else 0 end as has_air, case when class_code = 1 then 1 else 0 end as is_metro_area
  from fx_facilities)
"""


@query("facility_flags", with_fx("""
select facility_id, has_rail, has_bus, has_air, is_metro_area, has_rail + has_bus + has_air as modes_served from flags
""", _FLAGS_SQL))
def facility_flags(spark, sf_dir):
    f = _facility_flags(Fixtures(spark, sf_dir).facilities())
    return f.select("facility_id", "has_rail", "has_bus", "has_air", "is_metro_area", "modes_served")


@query("radius_flags", with_fx(f"""
select place_id, has_rail, has_bus, has_air, has_rail + has_bus + has_air as modes_served from (
 select p.place_id, cast(coalesce(max(f.has_rail), 0) as int) as has_rail, cast(coalesce(max(f.has_bus), 0) as int) as has_bus,
   cast(coalesce(max(f.has_air), 0) as int) as has_air
 from fx_places p left join flags f on {H('p.lat', 'p.lon', 'f.lat', 'f.lon')} <= 30.0e0 group by p.place_id) x
""", _FLAGS_SQL))
def radius_flags(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    f = _facility_flags(fx.facilities())
    r = SP.radius_flags(fx.places().select("place_id", "lat", "lon"),
                        _right(f, "facility_id", "has_rail", "has_bus", "has_air"),
                        ["has_rail", "has_bus", "has_air"], 30.0, left_id="place_id", count_col="modes_served")
    return r.select("place_id", "has_rail", "has_bus", "has_air", "modes_served")


@query("radius_count", with_fx(f"""
select p.place_id, count(s.site_id) as n_sites_50km
from fx_places p left join fx_sites s on {H('p.lat', 'p.lon', 's.lat', 's.lon')} <= 50.0e0 group by p.place_id
"""))
def radius_count(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    r = SP.radius_count(fx.places().select("place_id", "lat", "lon"), _right(fx.sites(), "site_id"), 50.0,
                        left_id="place_id", out="n_sites_50km")
    return r.select("place_id", "n_sites_50km")


def nearest_any_block(obs, sites):
    """Nearest site in any block, and whether its block disagrees with the observation's (NULL-safe)."""
    s = sites.select("site_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"),
                     F.col("state").alias("site_state"))
    n = SP.nearest_unbounded(obs.select("obs_id", "lat", "lon"), s, left_id="obs_id", right_id="site_id",
                             carry=["site_state"])
    j = obs.join(n, "obs_id", "left")
    suspect = F.col("site_id").isNotNull() & ~F.col("site_state").eqNullSafe(F.col("state"))
    return j.withColumn("coord_suspect", suspect)


_NEAREST_SQL = f"""
near AS (select obs_id, site_id, site_state, d from (
   select o.obs_id, s.site_id, s.state as site_state, {H('o.lat', 'o.lon', 's.lat', 's.lon')} as d,
     row_number() over (partition by o.obs_id order by {H('o.lat', 'o.lon', 's.lat', 's.lon')}, s.site_id) as rn
   from OBS o join fx_sites s on o.lat is not null and o.lon is not null) x where rn = 1),
sus AS (select o.obs_id, o.state, o.lat, o.lon, n.site_id as nearest_site, n.d as nearest_d,
   coalesce(n.site_id is not null and not (n.site_state is not distinct from o.state), false) as coord_suspect
   from OBS o left join near n on n.obs_id = o.obs_id)
"""


@query("coord_suspect", with_fx(f"""
select obs_id, nearest_site, {r6('nearest_d')} as nearest_km, coord_suspect from sus
""", _NEAREST_SQL.replace("OBS", "fx_obs_gaps")))
def coord_suspect(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    j = nearest_any_block(fx.obs_gaps(), fx.sites())
    return j.select("obs_id", F.col("site_id").alias("nearest_site"), round6("dist_km").alias("nearest_km"),
                    "coord_suspect")


def match_in_block(obs_flagged, sites, radius_km=30.0):
    """Nearest same-block site within the radius for observations not flagged as suspect."""
    o = obs_flagged.where(~F.col("coord_suspect")).select("obs_id", "lat", "lon", "state")
    s = sites.select("site_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"),
                     F.col("state").alias("r_state"))
    return SP.nearest_within(o, s, radius_km, left_id="obs_id", right_id="site_id", block=[("state", "r_state")])


@query("match_nearest_in_block", with_fx(f"""
select obs_id, site_id, {r6('d')} as dist_km from (
  select o.obs_id, s.site_id, {H('o.lat', 'o.lon', 's.lat', 's.lon')} as d,
    row_number() over (partition by o.obs_id order by {H('o.lat', 'o.lon', 's.lat', 's.lon')}, s.site_id) as rn
  from sus o join fx_sites s on s.state = o.state and {H('o.lat', 'o.lon', 's.lat', 's.lon')} <= 30.0e0
  where not o.coord_suspect) x where rn = 1
""", _NEAREST_SQL.replace("OBS", "fx_obs")))
def match_nearest_in_block(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    flagged = nearest_any_block(fx.obs(), fx.sites())
    m = match_in_block(flagged, fx.sites())
    return m.select("obs_id", "site_id", round6("dist_km").alias("dist_km"))


@query("match_nearest_2km", with_fx(f"""
select obs_id, site_id, {r6('d')} as dist_km from (
  select o.obs_id, s.site_id, {H('o.lat', 'o.lon', 's.lat', 's.lon')} as d,
    row_number() over (partition by o.obs_id order by {H('o.lat', 'o.lon', 's.lat', 's.lon')}, s.site_id) as rn
  from fx_obs_gaps o join fx_sites s on o.lat is not null and o.lon is not null
   and {H('o.lat', 'o.lon', 's.lat', 's.lon')} <= 2.0e0) x where rn = 1
"""))
def match_nearest_2km(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    m = SP.nearest_within(fx.obs_gaps().select("obs_id", "lat", "lon"), _right(fx.sites(), "site_id"), 2.0,
                          left_id="obs_id", right_id="site_id")
    return m.select("obs_id", "site_id", round6("dist_km").alias("dist_km"))


def area_centroids(sites):
    """Area table derived from the sites: one centroid per block, keyed by a zero-padded code."""
    return (sites.where(F.col("state").isNotNull()).groupBy("state")
            .agg(F.avg("lat").alias("r_lat"), F.avg("lon").alias("r_lon"))
            .select(F.lpad(F.col("state").cast("string"), 5, "0").alias("area_fips"), "r_lat", "r_lon"))


@query("resolve_area", with_fx(f"""
select p.place_id, n.area_fips, {r6('n.d')} as dist_km from fx_places p left join (
  select place_id, area_fips, d from (
    select p.place_id, a.area_fips, {H('p.lat', 'p.lon', 'a.lat', 'a.lon')} as d,
      row_number() over (partition by p.place_id order by {H('p.lat', 'p.lon', 'a.lat', 'a.lon')}, a.area_fips) as rn
    from fx_places p join areas a on {H('p.lat', 'p.lon', 'a.lat', 'a.lon')} <= 300.0e0) x where rn = 1) n
  on n.place_id = p.place_id
""", """
areas AS (select lpad(cast(state as varchar(10)), 5, '0') as area_fips, avg(lat) as lat, avg(lon) as lon
  from fx_sites where state is not null group by state)
"""))
def resolve_area(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    p = fx.places().select("place_id", "lat", "lon")
    n = SP.nearest_within(p, area_centroids(fx.sites()), 300.0, left_id="place_id", right_id="area_fips")
    return p.join(n, "place_id", "left").select("place_id", "area_fips", round6("dist_km").alias("dist_km"))


def candidate_places(fx, top_n=TOP_N_CANDIDATES, by_block=False):
    """Largest places (one per cleaned town, first by pop desc then id) whose town has no site.

    With ``by_block``, places and sites of one name in different blocks are different towns.
    """
    places = fx.places().withColumn("name_clean", F.lower(F.trim("town")))
    keys = ["name_clean", "state"] if by_block else ["name_clean"]
    dedup = keep_first(places, keys, [("pop", False), ("place_id", True)])
    top = dedup.orderBy(F.col("pop").desc(), F.col("place_id").asc()).limit(top_n)
    site_names = fx.sites().select(F.lower(F.trim("name")).alias("name_clean"), "state").select(*keys).distinct()
    c = top.join(site_names, keys, "left_anti")
    code = F.concat(F.lit("CAND_"), F.regexp_replace(F.trim("town"), "[^A-Za-z0-9]", "_"))
    return c.withColumn("code", code)


_CAND_SQL = f"""
cand AS (select 'CAND_' || regexp_replace(trim(town), '[^A-Za-z0-9]', '_', 'g') as code, place_id, name, town, state, pop, lat, lon
 from (select * from (select *, lower(trim(town)) as nc,
         row_number() over (partition by lower(trim(town)) order by pop desc, place_id) as rn from fx_places) d
       where rn = 1 order by pop desc, place_id limit {TOP_N_CANDIDATES}) t
 where nc not in (select lower(trim(name)) from fx_sites))
"""


@query("candidates_without_site", with_fx("select code, place_id, name, pop, lat, lon from cand", _CAND_SQL))
def candidates_without_site(spark, sf_dir):
    c = candidate_places(Fixtures(spark, sf_dir))
    return c.select("code", "place_id", "name", "pop", "lat", "lon")


@query("candidate_geo", with_fx(f"""
select c.code, m.metro_pop, {r6('d.dmin')} as distance_to_nearest_major_km, k.n as num_sites_80km
from cand c
left join (select code, coalesce(max(case when d <= 50.0e0 then pop end), max(pop)) as metro_pop from (
   select c.code, p.pop, {H('c.lat', 'c.lon', 'p.lat', 'p.lon')} as d from cand c
   left join fx_places p on {H('c.lat', 'c.lon', 'p.lat', 'p.lon')} <= 100.0e0) x group by code) m on m.code = c.code
left join (select c.code, min({H('c.lat', 'c.lon', 'p.lat', 'p.lon')}) as dmin from cand c
   join fx_places p on p.pop > {MAJOR_POP} group by c.code) d on d.code = c.code
left join (select c.code, count(s.site_id) as n from cand c left join fx_sites s
   on {H('c.lat', 'c.lon', 's.lat', 's.lon')} <= 80.0e0 group by c.code) k on k.code = c.code
""", _CAND_SQL))
def candidate_geo(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    c = candidate_places(fx).select("code", "lat", "lon")
    places = _right(fx.places(), "place_id", "pop")
    m = SP.radius_max_with_fallback(c, places, "pop", left_id="code")
    d = SP.nearest_distance(c, places.where(F.col("pop") > MAJOR_POP), left_id="code", right_id="place_id",
                            out="dmin").select("code", "dmin")
    k = SP.radius_count(c, _right(fx.sites(), "site_id"), 80.0, left_id="code", out="num_sites_80km").select(
        "code", "num_sites_80km")
    return (m.join(d, "code", "left").join(k, "code", "left")
            .select("code", "metro_pop", round6("dmin").alias("distance_to_nearest_major_km"), "num_sites_80km"))
