"""The composite jobs over the derived inputs; their oracles join the oracles of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand import jobs
from geodemand.functions.geo import haversine_sql, round6
from geodemand.plans.fixture_sql import r6, with_fx
from geodemand.plans.fixtures import Fixtures
from geodemand.plans.q_area import area_text, clean_area_stats
from geodemand.plans.q_matching import (_CASCADE_CTES, _EXACT_FIRST_CTES, OVERRIDE_NAME, OVERRIDE_SITE, area_titles, match_contains, obs_names,
                                        site_names)
from geodemand.plans.q_schedule import SCHED_CTES, feed
from geodemand.plans.q_spatial import _CAND_SQL, _FLAGS_SQL, _facility_flags, area_centroids, candidate_places
from geodemand.plans.registry import ORACLE, query

H = haversine_sql
_RULES = {"weekly_departures": "sum", "num_routes_served": "sum", "avg_dwell_time_sec": "mean", "max_route_length_km": "max", "is_terminal": "max"}
_FLAGS = ("has_rail", "has_bus", "has_air")


@query("job_spatial_features", with_fx(f"""
select s.site_id, s.name, m.metro_pop, d.distance_to_nearest_major_km, n.num_sites_nearby from fx_sites s
join ({ORACLE["radius_max_with_fallback"]}) m on m.site_id = s.site_id
join ({ORACLE["nearest_qualifying_distance"]}) d on d.site_id = s.site_id
join (select a.site_id, count(b.site_id) - 1 as num_sites_nearby from fx_sites a join fx_sites b
  on {H('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 80.0e0 group by a.site_id) n on n.site_id = s.site_id
"""))
def job_spatial_features(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    t = jobs.spatial_features(fx.sites(), fx.places())
    return t.select("site_id", "name", "metro_pop", round6("distance_to_nearest_major_km").alias("distance_to_nearest_major_km"), "num_sites_nearby")


@query("job_weight_features", with_fx(f"""
select s.site_id, s.name, s.state, w.weight_within_15km, w.weight_within_50km from fx_sites s
join ({ORACLE["radius_sum_multi"]}) w on w.site_id = s.site_id
"""))
def job_weight_features(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    t = jobs.weight_features(fx.sites(), fx.places())
    return t.select("site_id", "name", "state", *[F.col(f"weight_within_{r}km").cast("bigint").alias(f"weight_within_{r}km") for r in (15, 50)])


@query("job_schedule_features", with_fx(f"""
select n.n_nationkey as entity_id, n.n_name as name, r.weekly_departures, r.num_routes_served, r.avg_dwell_time_sec,
  r.max_route_length_km, r.is_terminal, r.n_stops
from nation n left join ({ORACLE["entity_rollup"]}) r on r.entity_id = n.n_nationkey
"""))
def job_schedule_features(spark, sf_dir):
    fx, trips_f, _ = feed(spark, sf_dir)
    nations = fx.t("nation").select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name"))
    stop_entity = fx.sites().select(F.col("site_id").alias("stop_id"), F.col("state").alias("entity_id"))
    t = jobs.schedule_features(nations, stop_entity, fx.stop_times(), trips_f, fx.stops(), _RULES)
    return t.select("entity_id", "name", F.col("weekly_departures").cast("bigint").alias("weekly_departures"),
                    F.col("num_routes_served").cast("bigint").alias("num_routes_served"),
                    round6("avg_dwell_time_sec").alias("avg_dwell_time_sec"),
                    round6("max_route_length_km").alias("max_route_length_km"), "is_terminal", "n_stops")


@query("job_candidates", with_fx(f"""
select r.*, g.metro_pop, g.distance_to_nearest_major_km, g.num_sites_80km as num_sites_nearby, a.area_fips,
  cast(coalesce(f.has_rail, 0) as int) as has_rail, cast(coalesce(f.has_bus, 0) as int) as has_bus,
  cast(coalesce(f.has_air, 0) as int) as has_air
from ({ORACLE["candidate_assemble"]}) r join ({ORACLE["candidate_geo"]}) g on g.code = r.code
join cand c on c.code = r.code join ({ORACLE["resolve_area"]}) a on a.place_id = c.place_id
left join (select c.code, max(f.has_rail) as has_rail, max(f.has_bus) as has_bus, max(f.has_air) as has_air from cand c
  join flags f on {H('c.lat', 'c.lon', 'f.lat', 'f.lon')} <= 30.0e0 group by c.code) f on f.code = r.code
""", _CAND_SQL.strip() + "," + _FLAGS_SQL))
def job_candidates(spark, sf_dir):
    from geodemand.plans.q_report import candidate_rows
    fx = Fixtures(spark, sf_dir)
    rows = candidate_rows(candidate_places(fx))
    t = jobs.candidate_features(rows, fx.places(), fx.sites(), area_centroids(fx.sites()), _facility_flags(fx.facilities()), _FLAGS)
    return t.withColumn("distance_to_nearest_major_km", round6("distance_to_nearest_major_km"))


@query("job_area_features", with_fx(f"""
select s.site_id, s.name, x.area_fips, t.total, t.median_income, t.share_drove, t.share_transit from fx_sites s
left join (select site_id, area_fips, row_number() over (partition by site_id order by d, area_fips) as rn from (
  select p.site_id, a.area_fips, {H('p.lat', 'p.lon', 'a.lat', 'a.lon')} as d from fx_sites p, (
    select lpad(cast(state as varchar(10)), 5, '0') as area_fips, avg(lat) as lat, avg(lon) as lon from fx_sites
    where state is not null group by state) a) y where d <= 300.0e0) x on x.site_id = s.site_id and x.rn = 1
left join ({ORACLE["area_stats_clean"]}) t on t.area_fips = x.area_fips
"""))
def job_area_features(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    t = jobs.area_features(fx.sites(), area_centroids(fx.sites()), clean_area_stats(area_text(fx)))
    return t.select("site_id", "name", "area_fips", "total", "median_income", round6("share_drove").alias("share_drove"),
                    round6("share_transit").alias("share_transit"))


@query("job_visitor_features", with_fx(f"""
select s.site_id, s.name, lpad(cast(s.site_id as varchar), 5, '0') as area_code, v.visitors, v.n_entries from fx_sites s
left join ({ORACLE["match_contains"]}) v on v.area_code = lpad(cast(s.site_id as varchar), 5, '0')
"""))
def job_visitor_features(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    site_area = area_titles(fx).select(F.col("ord").alias("site_id"), "area_code")
    t = jobs.visitor_features(fx.sites(), site_area, match_contains(spark, sf_dir))
    return t.select("site_id", "name", "area_code", "visitors", "n_entries")


@query("feature_defaults", with_fx(f"""
select id, cast(coalesce(nullif(n_finished, 3), 0) as int) as n_finished, cast(0 as int) as is_corridor,
  coalesce(nullif(pop, 0), 0.0e0) as pop, 0.0e0 as weight_15km, balance, cast(null as double) as visitors,
  coalesce(nullif(segment, 'HOUSEHOLD'), (select segment from fx_model where segment <> 'HOUSEHOLD' group by segment
    order by count(*) desc, segment limit 1)) as segment, 'unknown' as station_type, {r6('ln(1.0e0 + spend)')} as log_target
from fx_model
"""))
def feature_defaults(spark, sf_dir):
    m = Fixtures(spark, sf_dir).model_table().select(
        "id", F.nullif("n_finished", F.lit(3.0)).alias("n_finished"), F.nullif("pop", F.lit(0.0)).alias("pop"), "balance",
        F.nullif("segment", F.lit("HOUSEHOLD")).alias("segment"), "spend")
    t = jobs.feature_defaults(m, flags=("n_finished", "is_corridor"), zeros=("pop", "weight_15km"), missing=("balance", "visitors"),
                              categories={"segment": "unknown", "station_type": "unknown"}, target="spend")
    return t.select("id", "n_finished", "is_corridor", "pop", "weight_15km", "balance", "visitors", "segment", "station_type",
                    round6("log_target").alias("log_target"))


# ---- resolution ------------------------------------------------------------------------------

_GAP = "case when site_id % 9 = 0 then null else {0} end as {0}"
_GAP_SITES_SQL = f"gap_sites AS (select site_id, name, state, value, {_GAP.format('lat')}, {_GAP.format('lon')} from fx_sites)"
_SITE_FLAGS = {"rail_code": "has_rail", "bus_code": "has_bus", "air_code": "has_air"}
_SITE_OF_FACILITY = "case when facility_id % 3 = 0 then facility_id - 1 else facility_id end"


@query("job_resolve", with_fx(f"""
select s.site_id, s.name, s.state, coalesce(s.lat, a.lat) as lat, coalesce(s.lon, a.lon) as lon, {r6('a.total_value')} as total_value, a.n_obs,
  a.obs_names, case when a.n_obs > 1 then a.m || ' (summed)' else a.m end as match_method, f.has_rail, f.has_bus, f.has_air
from gap_sites s left join (
  select c.match_id, coalesce(sum(o.value), 0.0e0) as total_value, count(*) as n_obs, string_agg(o.raw_name, ' + ' order by o.obs_id) as obs_names,
    arg_min(c.match_method, o.obs_id) as m, arg_min(struct_pack(v := o.lat), o.obs_id).v as lat, arg_min(struct_pack(v := o.lon), o.obs_id).v as lon
  from casc c join fx_obs_gaps o on o.obs_id = c.obs_id where c.match_id is not null group by c.match_id) a on a.match_id = s.site_id
left join (select {_SITE_OF_FACILITY} as site_id,
  {", ".join(f"cast(arg_min(case when {c} in (1, 2) then 1 else 0 end, facility_id) as int) as {f}" for c, f in _SITE_FLAGS.items())}
  from fx_facilities group by 1) f on f.site_id = s.site_id
""", _GAP_SITES_SQL + "," + _CASCADE_CTES.replace("fx_sites", "gap_sites"), recursive=True))
def job_resolve(spark, sf_dir):
    """Observations through all tiers into the site table; every ninth site lacks coordinates, every third shares its neighbour's facts."""
    fx = Fixtures(spark, sf_dir)
    gap = F.col("site_id") % 9 == 0
    sites = fx.sites().select("site_id", "name", "state", *[F.when(~gap, F.col(c)).alias(c) for c in ("lat", "lon")])
    facts = fx.facilities().withColumn("site_id", F.expr(_SITE_OF_FACILITY))
    t = jobs.resolve_sites(obs_names(fx.obs_gaps()), site_names(sites), facts, {OVERRIDE_NAME: OVERRIDE_SITE}, flags=_SITE_FLAGS)
    return t.select("site_id", "name", "state", "lat", "lon", round6("total_value").alias("total_value"), "n_obs", "obs_names", "match_method",
                    "has_rail", "has_bus", "has_air")


_STOPS_SQL = """
stp AS (select site_id as obs_id, case when site_id % 4 = 0 then 'Halt' else name || ' Station' end as raw_name, lat, lon from fx_sites),
ent AS (select case when site_id % 5 = 0 then site_id else site_id + 1000000 end as site_id, name, lat, lon from fx_sites)"""


@query("job_schedule_matched", with_fx(f"""
select e.site_id as entity_id, e.name, r.weekly_departures, r.num_routes_served, r.avg_dwell_time_sec, r.is_terminal, r.n_stops
from ent e left join (
  select c.match_id, cast(sum(m.weekly_departures) as bigint) as weekly_departures, cast(sum(m.num_routes_served) as bigint) as num_routes_served,
    {r6('avg(m.avg_dwell_time_sec)')} as avg_dwell_time_sec, max(m.is_terminal) as is_terminal, count(*) as n_stops
  from (select stop_id, cast(coalesce(sum(days_per_week), 0) as bigint) as weekly_departures, count(distinct route_id) as num_routes_served,
     avg(dwell_sec) as avg_dwell_time_sec, max(case when stop_sequence = min_seq or stop_sequence = max_seq then 1 else 0 end) as is_terminal
    from sch_v group by stop_id) m join casc2 c on c.obs_id = m.stop_id where c.match_id is not null group by c.match_id) r
  on r.match_id = e.site_id
""", SCHED_CTES.strip() + "," + _STOPS_SQL + "," + _EXACT_FIRST_CTES.replace("fx_obs_gaps", "stp").replace("fx_sites", "ent"), recursive=True))
def job_schedule_matched(spark, sf_dir):
    """Service measures of entities whose stops are found by id, by name or by place."""
    fx, trips_f, _ = feed(spark, sf_dir)
    k = F.col("site_id")
    entities = fx.sites().select(F.when(k % 5 == 0, k).otherwise(k + 1000000).alias("entity_id"), "name", "lat", "lon")
    stops = fx.sites().select(k.alias("stop_id"), F.when(k % 4 == 0, "Halt").otherwise(F.concat("name", F.lit(" Station"))).alias("stop_name"),
                              F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"))
    rules = {c: _RULES[c] for c in ("weekly_departures", "num_routes_served", "avg_dwell_time_sec", "is_terminal")}
    t = jobs.schedule_features(entities, None, fx.stop_times(), trips_f, stops, rules)
    return t.select("entity_id", "name", F.col("weekly_departures").cast("bigint").alias("weekly_departures"),
                    F.col("num_routes_served").cast("bigint").alias("num_routes_served"),
                    round6("avg_dwell_time_sec").alias("avg_dwell_time_sec"), "is_terminal", "n_stops")
