"""Reporting queries: ratios, bands, segments, rule filters, top lists, display groups, JSON payload."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geodemand.functions import constants as K
from geodemand.functions.geo import round6, round_to_sql
from geodemand.operators import report as RP
from geodemand.operators.rows import keep_first, top_k, top_k_per_group
from geodemand.plans.fixture_sql import r6, with_fx
from geodemand.plans.fixtures import Fixtures
from geodemand.plans.q_schedule import SCHED_CTES, feed
from geodemand.plans.q_spatial import candidate_places, _CAND_SQL
from geodemand.plans.registry import query

UNSCORED_STATE = 3
# Display groups: (display name, member site ids) -- a parameter of the report.
DISPLAY_GROUPS = [("Group 0-1", [0, 1]), ("Group 2-3", [2, 3])]
TOP_PAIRS = 20
# The service measures that a candidate has not got yet.
SERVICE_COLUMNS = ("weekly_departures", "num_routes_served", "is_terminal", "avg_dwell_time_sec", "service_span_hours",
                   "avg_stop_sequence_pct", "num_directions", "avg_route_length_km", "max_route_length_km", "pct_long_distance")


def _p(digits, x):
    return round_to_sql(x, digits)


def scored_stations(fx):
    """Actual and predicted demand per site."""
    s = fx.sites()
    base = F.floor(F.abs(F.col("value")) * 100)
    actual = (base + 1).cast("bigint")
    predicted = F.floor((base + 1) * (F.lit(0.2) + (F.col("site_id") * 37 % 100) / F.lit(20.0))).cast("bigint")
    d = s.select(F.col("site_id").alias("stop_id"), "name", "lat", "lon", "state", actual.alias("actual"),
                 predicted.alias("predicted"))
    return RP.demand_ratio(d)


def overlay_stations(fx):
    """The scored sites that the route overlay knows: those of one block are stops without a score."""
    return scored_stations(fx).where(F.col("state") != UNSCORED_STATE)


_SCORED_SQL = f"""
st_scored AS (select site_id as stop_id, name, lat, lon, state, cast(floor(abs(value)*100) as bigint) + 1 as actual,
  cast(floor((floor(abs(value)*100) + 1) * (0.2e0 + ((site_id*37) % 100)/20.0e0)) as bigint) as predicted
  from fx_sites),
st_ratio AS (select *, {_p(3, 'actual / nullif(predicted, 0)')} as ratio from st_scored),
st_over AS (select p.stop_id, coalesce(r.name, p.stop_name) as name, r.ratio, r.actual from fx_stops p
  left join (select * from st_ratio where state <> {UNSCORED_STATE}) r on r.stop_id = p.stop_id),
rt_counts AS (select t.route_id, s.trip_id, count(*) as n_stops from sch_st s join sch_trips t on t.trip_id = s.trip_id
  group by t.route_id, s.trip_id),
rep AS (select route_id, trip_id, n_stops from (select *, row_number() over (partition by route_id order by n_stops desc, trip_id)
  as rn from rt_counts) x where rn = 1),
route_trips AS (select route_id, cast(coalesce(sum(days_per_week), 0) as bigint) as trips from sch_trips group by route_id),
segs AS (select x.route_id, x.trip_id, x.seq, x.from_stop, x.to_stop, rt.trips from (
   select r.route_id, s.trip_id, s.stop_sequence as seq, s.stop_id as from_stop,
     lead(s.stop_id) over (partition by s.trip_id order by s.stop_sequence) as to_stop
   from sch_st s join rep r on r.trip_id = s.trip_id) x left join route_trips rt on rt.route_id = x.route_id
  where x.to_stop is not null),
segs_scored AS (select g.*, a.name as from_name, a.ratio as from_r, b.name as to_name, b.ratio as to_r,
   coalesce({_p(3, '(a.ratio + b.ratio) / 2.0e0')}, a.ratio, b.ratio) as score
  from segs g left join st_over a on a.stop_id = g.from_stop left join st_over b on b.stop_id = g.to_stop),
emin AS (select stop_id, min(trips) as min_trips from (select from_stop as stop_id, trips from segs
  union all select to_stop as stop_id, trips from segs) e group by stop_id),
top20 AS (select name, min(rk) as rk from (select name, cast(row_number() over (order by ratio, stop_id) as integer) as rk
  from st_ratio where actual > {K.TOP20_MIN_ACTUAL} and ratio is not null order by ratio, stop_id limit 20) t group by name)
"""
_CTES = SCHED_CTES.strip() + ",\n" + _SCORED_SQL.strip()
_SHAPE_CTES = _CTES + "," + """
rep_st AS (select r.route_id, s.trip_id, s.stop_sequence, s.stop_id, p.stop_lat, p.stop_lon,
   lead(p.stop_lat) over (partition by s.trip_id order by s.stop_sequence) as nlat,
   lead(p.stop_lon) over (partition by s.trip_id order by s.stop_sequence) as nlon,
   row_number() over (partition by s.trip_id order by s.stop_sequence) - 1 as k
  from sch_st s join rep r on r.trip_id = s.trip_id join fx_stops p on p.stop_id = s.stop_id),
shp AS (select route_id, cast(k * 6 + i as int) as pt_seq,
   case when i = 0 then stop_lat else stop_lat + (nlat - stop_lat) * (i / 6.0e0) + i * 0.001e0 end as pt_lat,
   case when i = 0 then stop_lon else stop_lon + (nlon - stop_lon) * (i / 6.0e0) end as pt_lon
  from rep_st, (select unnest(range(0, 6)) as i) ii where i = 0 or nlat is not null),
stp AS (select route_id, stop_sequence as seq, stop_id, stop_lat as lat, stop_lon as lon,
   row_number() over (partition by route_id order by stop_sequence) as k from rep_st),
snap(route_id, k, idx) AS (
  select s.route_id, s.k, (select arg_min(p.pt_seq, struct_pack(d := (p.pt_lat - s.lat) * (p.pt_lat - s.lat)
      + (p.pt_lon - s.lon) * (p.pt_lon - s.lon), j := p.pt_seq)) from shp p where p.route_id = s.route_id)
  from stp s where s.k = 1
  union all
  select s.route_id, s.k, (select arg_min(p.pt_seq, struct_pack(d := (p.pt_lat - s.lat) * (p.pt_lat - s.lat)
      + (p.pt_lon - s.lon) * (p.pt_lon - s.lon), j := p.pt_seq)) from shp p where p.route_id = s.route_id
      and p.pt_seq >= sn.idx)
  from snap sn join stp s on s.route_id = sn.route_id and s.k = sn.k + 1),
snapped AS (select s.route_id, cast(s.seq as bigint) as seq, s.stop_id, cast(n.idx as bigint) as shape_idx
  from stp s join snap n on n.route_id = s.route_id and n.k = s.k)
"""


def _report_inputs(spark, sf_dir):
    """Fixtures, trips, representative trips and their stops; the small tables that all branches share are written once."""
    fx, trips_f, st_f = feed(spark, sf_dir)
    rep = RP.representative_trips(st_f, trips_f)
    rep_stops = (st_f.join(rep.select("trip_id", "route_id"), "trip_id")
                 .select("route_id", "trip_id", "stop_sequence", "stop_id").checkpoint())
    weekly = RP.weekly_trips(trips_f).checkpoint()
    return fx, rep, rep_stops, weekly


@query("demand_ratio", with_fx(f"""
select stop_id, actual, predicted, ratio, {_p(1, '(predicted - actual) / actual * 100.0e0')} as pct_error,
  {_p(6, 'ln(1.0e0 + predicted)')} as predicted_log from st_ratio
""", _CTES))
def demand_ratio(spark, sf_dir):
    s = RP.pct_error(scored_stations(Fixtures(spark, sf_dir)))
    return s.select("stop_id", "actual", "predicted", "ratio", "pct_error",
                    round6(F.log1p("predicted")).alias("predicted_log"))


@query("demand_bands", with_fx(f"""
select stop_id, ratio,
  case when ratio is null then '#888888' when ratio < {K.RATIO_SEVERE} then '#ef4444'
       when ratio < {K.RATIO_UNDERSERVED} then '#f97316' when ratio < {K.RATIO_BELOW_MODEL} then '#eab308'
       when ratio <= {K.RATIO_WELL_MATCHED_MAX} then '#22c55e' else '#06b6d4' end as color,
  case when ratio is null then 'unknown'
       when ratio < {K.RATIO_UNDERSERVED} then printf('%.1f× underserved', {_p(1, '1.0e0 / ratio')})
       when ratio < {K.RATIO_BELOW_MODEL} then printf('%.1f× below model', {_p(1, '1.0e0 / ratio')})
       when ratio <= {K.RATIO_WELL_MATCHED_MAX} then 'well-matched'
       else printf('%.1f× outperforms model', {_p(1, 'ratio')}) end as label
from st_ratio
""", _CTES))
def demand_bands(spark, sf_dir):
    s = scored_stations(Fixtures(spark, sf_dir))
    color, label = RP.ratio_band("ratio")
    return s.select("stop_id", "ratio", color.alias("color"), label.alias("label"))


@query("trip_weight", with_fx("""
select route_id, trips, case when trips > 140 then 5.0e0 when trips > 56 then 4.0e0 when trips > 28 then 3.0e0
  when trips > 14 then 2.5e0 else 2.0e0 end as weight from route_trips
""", _CTES))
def trip_weight(spark, sf_dir):
    _, trips_f, _ = feed(spark, sf_dir)
    w = RP.weekly_trips(trips_f)
    return w.select("route_id", "trips", RP.trip_weight("trips").alias("weight"))


@query("representative_trip", with_fx("select route_id, trip_id, n_stops from rep", _CTES))
def representative_trip(spark, sf_dir):
    _, trips_f, st_f = feed(spark, sf_dir)
    return RP.representative_trips(st_f, trips_f).select("route_id", "trip_id", "n_stops")


@query("consecutive_segments", with_fx("select route_id, trip_id, seq, from_stop, to_stop, trips from segs", _CTES))
def consecutive_segments(spark, sf_dir):
    _, _, rep_stops, weekly = _report_inputs(spark, sf_dir)
    return RP.consecutive_segments(rep_stops, weekly).select("route_id", "trip_id", "seq", "from_stop", "to_stop", "trips")


def _scored_segments(spark, sf_dir):
    fx, _, rep_stops, weekly = _report_inputs(spark, sf_dir)
    return fx, RP.score_segments(RP.consecutive_segments(rep_stops, weekly), overlay_stations(fx), fx.stops())


@query("segments_scored", with_fx("""
select route_id, seq, from_stop, to_stop, from_name, to_name, from_r, to_r, score, trips from segs_scored
""", _CTES))
def segments_scored(spark, sf_dir):
    _, s = _scored_segments(spark, sf_dir)
    return s.select("route_id", "seq", "from_stop", "to_stop", "from_name", "to_name", "from_r", "to_r", "score",
                    "trips")


@query("segments_low_freq", with_fx(f"""
select route_id, seq, trips <= {K.SUPPRESSED_MAX_TRIPS} as low_freq,
  coalesce(score < {K.RATIO_SUPPRESSED} and trips <= {K.SUPPRESSED_MAX_TRIPS}, false) as underserved_low
from segs_scored
""", _CTES))
def segments_low_freq(spark, sf_dir):
    _, s = _scored_segments(spark, sf_dir)
    low = F.col("trips") <= K.SUPPRESSED_MAX_TRIPS
    sup = F.coalesce((F.col("score") < K.RATIO_SUPPRESSED) & low, F.lit(False))
    return s.select("route_id", "seq", low.alias("low_freq"), sup.alias("underserved_low"))


@query("endpoint_min", with_fx("""
select s.stop_id, e.min_trips from st_ratio s left join emin e on e.stop_id = s.stop_id
""", _CTES))
def endpoint_min(spark, sf_dir):
    fx, _, rep_stops, weekly = _report_inputs(spark, sf_dir)
    e = RP.endpoint_min(RP.consecutive_segments(rep_stops, weekly))
    return scored_stations(fx).select("stop_id").join(e, "stop_id", "left")


@query("underserved_top20", with_fx("select name, rk from top20", _CTES))
def underserved_top20(spark, sf_dir):
    s = scored_stations(Fixtures(spark, sf_dir)).where(F.col("actual") > K.TOP20_MIN_ACTUAL)
    t = top_k(s, 20, [("ratio", True), ("stop_id", True)])
    ranked = t.withColumn("rk", F.row_number().over(Window.orderBy("ratio", "stop_id")))
    return ranked.groupBy("name").agg(F.min("rk").alias("rk"))


@query("filter_suppressed", with_fx(f"""
select s.stop_id, coalesce(s.ratio < {K.RATIO_BELOW_MODEL}, false) as underperforms,
  coalesce(s.ratio < {K.RATIO_SUPPRESSED} and e.min_trips <= {K.SUPPRESSED_MAX_TRIPS}, false) as suppressed,
  coalesce(s.ratio > {K.RATIO_WELL_MATCHED_MAX}, false) as outperforms, t.name is not null as in_top20
from st_ratio s left join emin e on e.stop_id = s.stop_id left join top20 t on t.name = s.name
""", _CTES))
def filter_suppressed(spark, sf_dir):
    fx, _, rep_stops, weekly = _report_inputs(spark, sf_dir)
    least = RP.endpoint_min(RP.consecutive_segments(rep_stops, weekly))
    s = scored_stations(fx).join(least, "stop_id", "left")
    top = underserved_top20(spark, sf_dir).select("name", F.lit(True).alias("in_top20"))
    j = s.join(F.broadcast(top), "name", "left")
    r = F.col("ratio")
    return j.select("stop_id",
                    F.coalesce(r < K.RATIO_BELOW_MODEL, F.lit(False)).alias("underperforms"),
                    F.coalesce((r < K.RATIO_SUPPRESSED) & (F.col("min_trips") <= K.SUPPRESSED_MAX_TRIPS),
                               F.lit(False)).alias("suppressed"),
                    F.coalesce(r > K.RATIO_WELL_MATCHED_MAX, F.lit(False)).alias("outperforms"),
                    F.coalesce(F.col("in_top20"), F.lit(False)).alias("in_top20"))


@query("unordered_pair_topk", with_fx(f"""
select trim(split_part(from_name, ',', 1)) as from_short, trim(split_part(to_name, ',', 1)) as to_short, score, rk from (
 select *, cast(row_number() over (order by score, route_id, seq) as integer) as rk from (
  select *, row_number() over (partition by least(from_name, to_name), greatest(from_name, to_name)
     order by score, route_id, seq) as pr from segs_scored where score is not null) x where pr = 1) y
where rk <= {TOP_PAIRS}
""", _CTES))
def unordered_pair_topk(spark, sf_dir):
    _, s = _scored_segments(spark, sf_dir)
    best = RP.best_per_unordered_pair(s, ["route_id", "seq"])
    top = best.orderBy("score", "route_id", "seq").limit(TOP_PAIRS)
    top = top.withColumn("rk", F.row_number().over(Window.orderBy("score", "route_id", "seq")))
    short = lambda c: F.trim(F.split_part(F.col(c), F.lit(","), F.lit(1)))
    return top.select(short("from_name").alias("from_short"), short("to_name").alias("to_short"), "score", "rk")


def _radius_sql(table, value):
    lv = f"ln(1.0e0 + greatest(cast({value} as double), 0.0e0))"
    return (f"case when b.hi > b.lo then {_p(1, f'5.0e0 + ({lv} - b.lo) / (b.hi - b.lo) * 17.0e0')} else 13.5e0 end",
            f"(select min({lv}) as lo, max({lv}) as hi from {table}) b")


_R_EXPR, _R_FROM = _radius_sql("st_ratio", "actual")


@query("log_scale", with_fx(f"select stop_id, actual, {_R_EXPR} as radius from st_ratio, {_R_FROM}", _CTES))
def log_scale_q(spark, sf_dir):
    s = scored_stations(Fixtures(spark, sf_dir))
    return RP.log_scale(s, "actual").select("stop_id", "actual", "radius")


_GM_SQL = ", ".join(f"('{n}', {i})" for n, ids in DISPLAY_GROUPS for i in ids)
_G_EXPR, _G_FROM = _radius_sql("gr", "actual")
_DG_CTES = _CTES + f""",
gm AS (select * from (values {_GM_SQL}) as t(display_name, stop_id)),
meas AS (select stop_id, cast(coalesce(sum(days_per_week), 0) as bigint) as weekly_departures from sch_v group by stop_id),
gr AS (select coalesce(gm.display_name, s.name) as display_name, sum(s.actual) as actual, sum(s.predicted) as predicted,
   avg(s.lat) as lat, avg(s.lon) as lon, avg(m.weekly_departures) as weekly_departures, count(*) as n_members,
   {_p(3, 'sum(s.actual) / nullif(sum(s.predicted), 0)')} as ratio
  from st_ratio s left join meas m on m.stop_id = s.stop_id left join gm on gm.stop_id = s.stop_id
  group by coalesce(gm.display_name, s.name))"""


@query("display_groups", with_fx(f"""
select display_name, cast(actual as bigint) as actual, cast(predicted as bigint) as predicted, {r6('lat')} as lat,
  {r6('lon')} as lon, {r6('weekly_departures')} as weekly_departures, n_members, ratio, {_G_EXPR} as radius
from gr, {_G_FROM}
""", _DG_CTES))
def display_groups(spark, sf_dir):
    """Co-located stations shown as one record: sums, ratio of sums, mean position; members leave the plain list."""
    fx = Fixtures(spark, sf_dir)
    s = scored_stations(fx)
    m = _measures_for(spark, sf_dir)
    s = s.join(m, "stop_id", "left")
    rows = [(name, sid) for name, ids in DISPLAY_GROUPS for sid in ids]
    gm = spark.createDataFrame(rows, "display_name string, stop_id long")
    j = s.join(F.broadcast(gm), "stop_id", "left").withColumn(
        "display_name", F.coalesce(F.col("display_name"), F.col("name")))
    key = F.coalesce(F.col("display_name"), F.col("stop_id").cast("string"))
    g = j.groupBy(key.alias("display_name")).agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("weekly_departures").alias("weekly_departures"),
        F.count(F.lit(1)).alias("n_members"))
    g = RP.demand_ratio(g)
    g = RP.log_scale(g, "actual")
    return g.select("display_name", "actual", "predicted", round6("lat").alias("lat"), round6("lon").alias("lon"),
                    round6("weekly_departures").alias("weekly_departures"), "n_members", "ratio", "radius")


def _measures_for(spark, sf_dir):
    from geodemand.operators.schedule import stop_service_measures
    fx, trips_f, st_f = feed(spark, sf_dir)
    return stop_service_measures(st_f, trips_f, fx.stops()).select("stop_id", "weekly_departures")


def route_shapes(placed):
    """Polylines derived from each representative trip: five interpolated, slightly offset points per leg."""
    w = Window.partitionBy("route_id").orderBy("seq")
    legs = placed.select("route_id", "lat", "lon", F.lead("lat").over(w).alias("nlat"), F.lead("lon").over(w).alias("nlon"),
                         (F.row_number().over(w) - 1).alias("k"))
    pts = legs.withColumn("i", F.explode(F.when(F.col("nlat").isNull(), F.array(F.lit(0)))
                                         .otherwise(F.sequence(F.lit(0), F.lit(5)))))
    frac = F.col("i") / 6.0
    off = F.col("i") * 0.001
    return pts.select(
        "route_id", (F.col("k") * 6 + F.col("i")).cast("int").alias("pt_seq"),
        F.when(F.col("i") == 0, F.col("lat")).otherwise(
            F.col("lat") + (F.col("nlat") - F.col("lat")) * frac + off).alias("pt_lat"),
        F.when(F.col("i") == 0, F.col("lon")).otherwise(
            F.col("lon") + (F.col("nlon") - F.col("lon")) * frac).alias("pt_lon"))


def _snapped(spark, sf_dir):
    fx, _, rep_stops, weekly = _report_inputs(spark, sf_dir)
    placed = rep_stops.join(fx.stops(), "stop_id").select(
        "route_id", "trip_id", F.col("stop_sequence").alias("seq"), "stop_id", F.col("stop_lat").alias("lat"),
        F.col("stop_lon").alias("lon")).checkpoint()
    shapes = route_shapes(placed)
    return fx, rep_stops, weekly, shapes, RP.snap_monotone(placed, shapes)


@query("snap_monotone", with_fx("select route_id, seq, stop_id, shape_idx from snapped", _SHAPE_CTES,
                                 recursive=True))
def snap_monotone(spark, sf_dir):
    *_, snapped = _snapped(spark, sf_dir)
    return snapped.select("route_id", "seq", "stop_id", "shape_idx")


def _segment_coords(spark, sf_dir):
    fx, rep_stops, weekly, shapes, snapped = _snapped(spark, sf_dir)
    line = shapes.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pt_seq", "pt_lat", "pt_lon"))).alias(
        "pts")).select("route_id", F.transform("pts", lambda p: F.struct(p["pt_lat"].alias("lat"),
                                                                      p["pt_lon"].alias("lon"))).alias("pts"))
    along = Window.partitionBy("route_id").orderBy("seq")
    legs = snapped.select("route_id", F.col("seq").cast("int").alias("seq"), F.col("stop_id").alias("from_stop"), F.lead("stop_id").over(along).alias("to_stop"),
                          F.col("shape_idx").alias("idx_a"), F.lead("shape_idx").over(along).alias("idx_b"))
    j = legs.where("to_stop is not null").join(line, "route_id").join(weekly, "route_id", "left")
    coords = RP.downsample_coords(F.col("pts"), F.col("idx_a").cast("int"), F.col("idx_b").cast("int"))
    return fx, j.withColumn("coords", coords).drop("pts")


@query("polyline_downsample", with_fx(f"""
select g.route_id, g.seq, g.from_stop, g.to_stop, c.coords, cast(len(c.coords) as integer) as n_points
from segs g left join (
  select a.route_id, a.seq, case when b.shape_idx > a.shape_idx then (
      select list([{_p(4, 'p.pt_lat')}, {_p(4, 'p.pt_lon')}] order by p.pt_seq) from shp p
      where p.route_id = a.route_id and p.pt_seq between a.shape_idx and b.shape_idx
        and ((p.pt_seq - a.shape_idx) % 6 = 0 or p.pt_seq = b.shape_idx)) end as coords
  from (select *, lead(seq) over (partition by route_id order by seq) as seq_b from snapped) a
  join snapped b on b.route_id = a.route_id and b.seq = a.seq_b) c on c.route_id = g.route_id and c.seq = g.seq
""", _SHAPE_CTES, recursive=True))
def polyline_downsample(spark, sf_dir):
    _, j = _segment_coords(spark, sf_dir)
    return j.select("route_id", "seq", "from_stop", "to_stop", "coords", F.size("coords").alias("n_points"))


@query("segment_json", with_fx(f"""
select g.route_id, g.seq, to_json(struct_pack(route := g.route_id, "from" := g.from_name, "to" := g.to_name,
    coords := g.coords, score := g.score, trips := g.trips, from_r := g.from_r, to_r := g.to_r,
    from_rid := g.from_rid, to_rid := g.to_rid,
    mid := [(list_min(list_transform(g.coords, lambda p: p[1])) + list_max(list_transform(g.coords, lambda p: p[1]))) / 2.0e0,
            (list_min(list_transform(g.coords, lambda p: p[2])) + list_max(list_transform(g.coords, lambda p: p[2]))) / 2.0e0]
  ))::varchar as json
from (select ss.route_id, ss.seq, ss.from_name, ss.to_name, ss.score, ss.trips, ss.from_r, ss.to_r,
        a.actual as from_rid, b.actual as to_rid,
        coalesce(c.coords, [[{_p(4, 'pa.stop_lat')}, {_p(4, 'pa.stop_lon')}], [{_p(4, 'pb.stop_lat')}, {_p(4, 'pb.stop_lon')}]])
          as coords
      from segs_scored ss
      left join st_over a on a.stop_id = ss.from_stop left join st_over b on b.stop_id = ss.to_stop
      left join fx_stops pa on pa.stop_id = ss.from_stop left join fx_stops pb on pb.stop_id = ss.to_stop
      left join seg_coords c on c.route_id = ss.route_id and c.seq = ss.seq) g
""", _SHAPE_CTES + f""",
seg_coords AS (select a.route_id, a.seq, case when b.shape_idx > a.shape_idx then (
      select list([{_p(4, 'p.pt_lat')}, {_p(4, 'p.pt_lon')}] order by p.pt_seq) from shp p
      where p.route_id = a.route_id and p.pt_seq between a.shape_idx and b.shape_idx
        and ((p.pt_seq - a.shape_idx) % 6 = 0 or p.pt_seq = b.shape_idx)) end as coords
  from (select *, lead(seq) over (partition by route_id order by seq) as seq_b from snapped) a
  join snapped b on b.route_id = a.route_id and b.seq = a.seq_b)""", recursive=True))
def segment_json(spark, sf_dir):
    """Segment records as JSON text: coordinates (shape slice or straight line), bbox midpoint, score, trips."""
    fx, j = _segment_coords(spark, sf_dir)
    stops = fx.stops()
    s = RP.score_segments(j, overlay_stations(fx), stops)
    a = stops.select(F.col("stop_id").alias("from_stop"), F.col("stop_lat").alias("alat"),
                     F.col("stop_lon").alias("alon"))
    b = stops.select(F.col("stop_id").alias("to_stop"), F.col("stop_lat").alias("blat"),
                     F.col("stop_lon").alias("blon"))
    s = s.join(a, "from_stop", "left").join(b, "to_stop", "left")
    straight = F.array(F.array(RP.round_to("alat", 4), RP.round_to("alon", 4)),
                       F.array(RP.round_to("blat", 4), RP.round_to("blon", 4)))
    coords = F.coalesce(F.col("coords"), straight)
    lats = F.transform(coords, lambda p: p[0])
    lons = F.transform(coords, lambda p: p[1])
    mid = F.array((F.array_min(lats) + F.array_max(lats)) / 2.0, (F.array_min(lons) + F.array_max(lons)) / 2.0)
    rec = F.struct(F.col("route_id").alias("route"), F.col("from_name").alias("from"), F.col("to_name").alias("to"),
                   coords.alias("coords"), F.col("score"), F.col("trips"), F.col("from_r"), F.col("to_r"),
                   F.col("from_rid"), F.col("to_rid"), mid.alias("mid"))
    return s.select("route_id", "seq", F.to_json(rec, {"ignoreNullFields": "false"}).alias("json"))


# ---- top lists and keep-first ---------------------------------------------------------------

@query("topk", with_fx("select place_id, pop from fx_places order by pop desc, place_id limit 10"))
def topk(spark, sf_dir):
    return top_k(Fixtures(spark, sf_dir).places(), 10, [("pop", False), ("place_id", True)]).select("place_id", "pop")


@query("topk_per_group", with_fx("""
select state, place_id, pop, rank from (select state, place_id, pop,
  cast(row_number() over (partition by state order by pop desc, place_id) as integer) as rank from fx_places) x where rank <= 3
"""))
def topk_per_group(spark, sf_dir):
    p = Fixtures(spark, sf_dir).places()
    return top_k_per_group(p, "state", 3, [("pop", False), ("place_id", True)]).select("state", "place_id", "pop",
                                                                                         "rank")


@query("dedupe_first", with_fx("""
select name_clean, place_id, pop from (select lower(trim(town)) as name_clean, place_id, pop,
  row_number() over (partition by lower(trim(town)) order by pop desc, place_id) as rn from fx_places) x
where rn = 1
"""))
def dedupe_first(spark, sf_dir):
    p = Fixtures(spark, sf_dir).places().select(F.lower(F.trim("town")).alias("name_clean"), "place_id", "pop")
    return keep_first(p, ["name_clean"], [("pop", False), ("place_id", True)])


@query("candidate_assemble", with_fx(f"""
select code, trim(town) || ' (Expansion Candidate)' as station_name, 'Expansion Candidate' as station_type, lat, lon, state,
  cast(null as bigint) as actual, 0 as is_corridor, 1 as is_candidate,
  {", ".join(f"cast(null as double) as {c}" for c in SERVICE_COLUMNS)}
from cand
""", _CAND_SQL))
def candidate_assemble(spark, sf_dir):
    return candidate_rows(candidate_places(Fixtures(spark, sf_dir)))


def candidate_rows(c):
    """Candidate rows in the schema of scored stations: constant flags, no target, service measures missing."""
    return c.select("code", F.concat(F.trim("town"), F.lit(" (Expansion Candidate)")).alias("station_name"),
                    F.lit("Expansion Candidate").alias("station_type"), "lat", "lon", "state",
                    F.lit(None).cast("bigint").alias("actual"), F.lit(0).alias("is_corridor"), F.lit(1).alias("is_candidate"),
                    *[F.lit(None).cast("double").alias(m) for m in SERVICE_COLUMNS])
