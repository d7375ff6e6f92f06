"""Timetable queries (flagship: ``stop_service_measures``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand.functions.geo import haversine_sql, round6
from geodemand.functions.timefmt import hhmmss_sql
from geodemand.operators import schedule as S
from geodemand.plans.fixture_sql import r6, with_fx
from geodemand.plans.fixtures import Fixtures
from geodemand.plans.registry import query

DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
KEEP_KINDS = ("O", "F")
EXCLUDED_ROUTE = 7
FLAG_ROUTE = 3


def feed(spark, sf_dir):
    """Filtered timetable of the derived feed: (fixtures, trips with days, stop times)."""
    fx = Fixtures(spark, sf_dir)
    trips = S.trips_with_days(fx.trips(), S.service_days(fx.calendar(), DAYS))
    trips_f, st_f = S.filter_schedule(trips, fx.stop_times(), keep=F.col("kind").isin(*KEEP_KINDS))
    return fx, trips_f, st_f


_DEP = hhmmss_sql("s.departure_time")
_ARR = hhmmss_sql("s.arrival_time")
SCHED_CTES = f"""
sch_days AS (select service_id, coalesce(mon,0)+coalesce(tue,0)+coalesce(wed,0)+coalesce(thu,0)+coalesce(fri,0)
   +coalesce(sat,0)+coalesce(sun,0) as days_per_week from fx_calendar),
sch_trips AS (select t.trip_id, t.route_id, t.direction_id, t.service_id, t.kind, coalesce(d.days_per_week, 0) as days_per_week
   from fx_trips t left join sch_days d on d.service_id = t.service_id where t.kind in ('O', 'F')),
sch_st AS (select * from fx_stop_times where trip_id in (select trip_id from sch_trips)),
sch_ext AS (select trip_id, min(stop_sequence) as min_seq, max(stop_sequence) as max_seq,
   arg_min(stop_id, stop_sequence) as first_stop, arg_max(stop_id, stop_sequence) as last_stop from sch_st group by trip_id),
sch_rlen AS (select t.route_id, max({haversine_sql('a.stop_lat', 'a.stop_lon', 'b.stop_lat', 'b.stop_lon')}) as route_len_km
   from sch_ext e join fx_stops a on a.stop_id = e.first_stop join fx_stops b on b.stop_id = e.last_stop
   join sch_trips t on t.trip_id = e.trip_id group by t.route_id),
sch_v AS (select s.trip_id, s.stop_id, s.stop_sequence, {_ARR} as arr_sec, {_DEP} as dep_sec, {_DEP} - {_ARR} as dwell_sec,
   e.min_seq, e.max_seq, t.route_id, t.direction_id, t.days_per_week, r.route_len_km
   from sch_st s join sch_ext e on e.trip_id = s.trip_id join sch_trips t on t.trip_id = s.trip_id
   left join sch_rlen r on r.route_id = t.route_id where s.stop_id is not null)
"""

MEASURE_COLS = ["weekly_departures", "num_routes_served", "is_terminal", "avg_dwell_time_sec", "service_span_hours",
                "avg_stop_sequence_pct", "num_directions", "avg_route_length_km", "max_route_length_km",
                "pct_long_distance"]
_DOUBLE_MEASURES = {"avg_dwell_time_sec", "service_span_hours", "avg_stop_sequence_pct", "avg_route_length_km",
                    "max_route_length_km", "pct_long_distance"}


def _measures(spark, sf_dir):
    # The operator inner-joins visits to the (filtered) trips, which already applies the
    # semi join of the feed filter: pass the raw visits and save a shuffle in each pass.
    fx, trips_f, _ = feed(spark, sf_dir)
    return S.stop_service_measures(fx.stop_times(), trips_f, fx.stops())


@query("stop_service_measures", with_fx(f"""
select m.stop_id, m.weekly_departures, m.num_routes_served, m.is_terminal,
  {r6('m.avg_dwell_time_sec')} as avg_dwell_time_sec, {r6('m.service_span_hours')} as service_span_hours,
  {r6('m.avg_stop_sequence_pct')} as avg_stop_sequence_pct, m.num_directions,
  {r6('m.avg_route_length_km')} as avg_route_length_km, {r6('m.max_route_length_km')} as max_route_length_km,
  {r6('m.pct_long_distance')} as pct_long_distance, p.stop_name, p.stop_lat, p.stop_lon
from (select stop_id, cast(coalesce(sum(days_per_week), 0) as bigint) as weekly_departures,
   count(distinct route_id) as num_routes_served,
   max(case when stop_sequence = min_seq or stop_sequence = max_seq then 1 else 0 end) as is_terminal,
   avg(dwell_sec) as avg_dwell_time_sec, (max(dep_sec) - min(dep_sec)) / 3600.0e0 as service_span_hours,
   avg(stop_sequence / max_seq) as avg_stop_sequence_pct, count(distinct direction_id) as num_directions,
   avg(route_len_km) as avg_route_length_km, max(route_len_km) as max_route_length_km,
   count(distinct case when route_len_km > 500.0e0 then route_id end) / count(distinct route_id) as pct_long_distance
  from sch_v group by stop_id) m left join fx_stops p on p.stop_id = m.stop_id
""", SCHED_CTES))
def stop_service_measures(spark, sf_dir):
    m = _measures(spark, sf_dir)
    return m.select("stop_id", *[round6(c).alias(c) if c in _DOUBLE_MEASURES else F.col(c) for c in MEASURE_COLS],
                    "stop_name", "stop_lat", "stop_lon")


@query("schedule_filter", with_fx(f"""
select s.trip_id, s.stop_id, s.stop_sequence from fx_stop_times s
where s.trip_id in (select trip_id from fx_trips where kind in ('O', 'F')
                    and (route_id is null or route_id not in ({EXCLUDED_ROUTE})))
"""))
def schedule_filter(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    _, st = S.filter_schedule(fx.trips(), fx.stop_times(), keep=F.col("kind").isin(*KEEP_KINDS),
                              exclude_routes=[EXCLUDED_ROUTE])
    return st.select("trip_id", "stop_id", "stop_sequence")


@query("service_days", with_fx("""
select t.trip_id, t.service_id, t.days_per_week from sch_trips t
""", SCHED_CTES))
def service_days_q(spark, sf_dir):
    _, trips_f, _ = feed(spark, sf_dir)
    return trips_f.select("trip_id", "service_id", "days_per_week")


@query("visits_with_trip", with_fx("""
select s.trip_id, s.stop_id, s.stop_sequence, t.route_id, t.direction_id, t.days_per_week
from sch_st s left join sch_trips t on t.trip_id = s.trip_id
""", SCHED_CTES))
def visits_with_trip(spark, sf_dir):
    _, trips_f, st_f = feed(spark, sf_dir)
    j = st_f.join(trips_f.select("trip_id", "route_id", "direction_id", "days_per_week"), "trip_id", "left")
    return j.select("trip_id", "stop_id", "stop_sequence", "route_id", "direction_id", "days_per_week")


@query("visit_times", with_fx("""
select trip_id, stop_id, stop_sequence, arr_sec, dep_sec, dwell_sec from sch_v
""", SCHED_CTES))
def visit_times_q(spark, sf_dir):
    _, _, st_f = feed(spark, sf_dir)
    v = S.visit_times(st_f.where(F.col("stop_id").isNotNull()))
    return v.select("trip_id", "stop_id", "stop_sequence", "arr_sec", "dep_sec", "dwell_sec")


@query("visit_position", with_fx(f"""
select trip_id, stop_id, stop_sequence, max_seq, {r6('stop_sequence / max_seq')} as seq_pct,
  case when stop_sequence = min_seq then 1 else 0 end as is_first,
  case when stop_sequence = max_seq then 1 else 0 end as is_last
from sch_v
""", SCHED_CTES))
def visit_position_q(spark, sf_dir):
    _, _, st_f = feed(spark, sf_dir)
    v = S.visit_position(st_f.where(F.col("stop_id").isNotNull()))
    return v.select("trip_id", "stop_id", "stop_sequence", "max_seq", round6("seq_pct").alias("seq_pct"),
                    "is_first", "is_last")


@query("route_length", with_fx(f"""
select route_id, {r6('route_len_km')} as route_len_km from sch_rlen
""", SCHED_CTES))
def route_length_q(spark, sf_dir):
    fx, trips_f, st_f = feed(spark, sf_dir)
    r = S.route_length(S.trip_extent(st_f), trips_f, fx.stops())
    return r.select("route_id", round6("route_len_km").alias("route_len_km"))


@query("stop_long_share", with_fx(f"""
select p.stop_id, {r6('avg(case when r.route_len_km > 500.0e0 then 1.0e0 else 0.0e0 end)')} as pct_long_distance,
  count(*) as n_routes
from (select distinct s.stop_id, t.route_id from sch_st s join sch_trips t on t.trip_id = s.trip_id
      where s.stop_id is not null) p
left join sch_rlen r on r.route_id = p.route_id group by p.stop_id
""", SCHED_CTES))
def stop_long_share_q(spark, sf_dir):
    fx, trips_f, st_f = feed(spark, sf_dir)
    r = S.stop_long_share(st_f, trips_f, fx.stops())
    return r.select("stop_id", round6("pct_long_distance").alias("pct_long_distance"), "n_routes")


@query("entity_rollup", with_fx(f"""
select p.state as entity_id, cast(sum(m.weekly_departures) as bigint) as weekly_departures,
  cast(sum(m.num_routes_served) as bigint) as num_routes_served,
  {r6('avg(m.avg_dwell_time_sec)')} as avg_dwell_time_sec, {r6('max(m.max_route_length_km)')} as max_route_length_km,
  max(m.is_terminal) as is_terminal, count(*) as n_stops
from (select stop_id, cast(coalesce(sum(days_per_week), 0) as bigint) as weekly_departures,
   count(distinct route_id) as num_routes_served, avg(dwell_sec) as avg_dwell_time_sec,
   max(route_len_km) as max_route_length_km,
   max(case when stop_sequence = min_seq or stop_sequence = max_seq then 1 else 0 end) as is_terminal
  from sch_v group by stop_id) m join fx_sites p on p.site_id = m.stop_id
where p.state is not null group by p.state
""", SCHED_CTES))
def entity_rollup_q(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    m = _measures(spark, sf_dir)
    stop_entity = fx.sites().select(F.col("site_id").alias("stop_id"), F.col("state").alias("entity_id"))
    r = S.entity_rollup(m, stop_entity, {"weekly_departures": "sum", "num_routes_served": "sum",
                                         "avg_dwell_time_sec": "mean", "max_route_length_km": "max",
                                         "is_terminal": "max"})
    return r.select("entity_id", F.col("weekly_departures").cast("bigint").alias("weekly_departures"),
                    F.col("num_routes_served").cast("bigint").alias("num_routes_served"),
                    round6("avg_dwell_time_sec").alias("avg_dwell_time_sec"),
                    round6("max_route_length_km").alias("max_route_length_km"), "is_terminal", "n_stops")


@query("route_membership_flag", with_fx(f"""
select n.n_nationkey as entity_id,
  case when n.n_nationkey in (select p.state from fx_sites p where p.site_id in (
     select s.stop_id from sch_st s where s.trip_id in (select trip_id from sch_trips where route_id = {FLAG_ROUTE})))
   then 1 else 0 end as on_flag_route
from nation n
""", SCHED_CTES))
def route_membership_flag_q(spark, sf_dir):
    fx, trips_f, st_f = feed(spark, sf_dir)
    routes = trips_f.select("route_id").where(F.col("route_id") == FLAG_ROUTE).distinct()
    ents = fx.t("nation").select(F.col("n_nationkey").alias("entity_id"))
    stop_entity = fx.sites().select(F.col("site_id").alias("stop_id"), F.col("state").alias("entity_id"))
    r = S.route_membership_flag(ents, stop_entity, st_f, trips_f, routes, "on_flag_route")
    return r.select("entity_id", F.col("on_flag_route").cast("int").alias("on_flag_route"))
