"""Timetable analytics: service filtering, visit positions, route lengths, per-stop measures.

Every function maps DataFrames to a DataFrame. Column names follow the
usual timetable-feed names (trip_id, stop_id, stop_sequence, ...); rename
inputs before calling when they differ.

Scale notes
* Per-trip facts (first/last stop, max sequence) come from one ``groupBy``
  with map-side partial aggregation, then an equi join back. Unlike a
  ``Window.partitionBy(trip)`` this never needs a whole trip in one task, and
  AQE can split a hot trip in the join.
* Per-stop measures are summed by (stop, route) first, then by stop.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodemand.functions.constants import LONG_ROUTE_KM
from geodemand.functions.geo import haversine_km
from geodemand.functions.timefmt import hhmmss_to_seconds

# Calendar day columns of a timetable feed, Monday first.
FEED_DAY_COLUMNS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


@dataclass
class Schedule:
    """A timetable feed as DataFrames (shapes optional)."""
    routes: DataFrame | None
    trips: DataFrame
    stop_times: DataFrame
    stops: DataFrame
    calendar: DataFrame | None = None
    shapes: DataFrame | None = None


def service_days(calendar: DataFrame, day_cols=FEED_DAY_COLUMNS, service_col: str = "service_id") -> DataFrame:
    """Days of service per week = row-wise sum of day flags; a missing flag counts 0."""
    total = reduce(add, [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in day_cols])
    return calendar.select(F.col(service_col), total.alias("days_per_week"))


def trips_with_days(trips: DataFrame, days: DataFrame, service_col: str = "service_id") -> DataFrame:
    """Attach days_per_week to trips; trips whose service is unknown run 0 days."""
    j = trips.join(days, on=service_col, how="left")
    return j.withColumn("days_per_week", F.coalesce(F.col("days_per_week"), F.lit(0)))


def filter_schedule(trips: DataFrame, stop_times: DataFrame, keep=None, exclude_routes=None,
                    route_col: str = "route_id", trip_col: str = "trip_id"):
    """Restrict a feed to one service kind: trips by predicate and route exclusion, stop times by semi join.

    ``exclude_routes`` follows pandas ``~isin``: rows with a NULL route are kept.
    Returns (trips, stop_times).
    """
    t = trips
    if keep is not None:
        t = t.where(keep)
    if exclude_routes:
        r = F.col(route_col)
        t = t.where(r.isNull() | ~r.isin(list(exclude_routes)))
    st = stop_times.join(t.select(trip_col), on=trip_col, how="left_semi")
    return t, st


def filter_routes_then_trips(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, keep,
                             route_col: str = "route_id", trip_col: str = "trip_id"):
    """The chained form: routes by predicate -> trips semi routes -> stop_times semi trips."""
    r = routes.where(keep)
    t = trips.join(r.select(route_col), on=route_col, how="left_semi")
    st = stop_times.join(t.select(trip_col), on=trip_col, how="left_semi")
    return r, t, st


def visit_times(stop_times: DataFrame) -> DataFrame:
    """Arrival / departure seconds and dwell (departure - arrival)."""
    arr = hhmmss_to_seconds("arrival_time")
    dep = hhmmss_to_seconds("departure_time")
    return stop_times.withColumns({"arr_sec": arr, "dep_sec": dep}).withColumn(
        "dwell_sec", F.col("dep_sec") - F.col("arr_sec"))


def trip_extent(stop_times: DataFrame) -> DataFrame:
    """Per trip: first/last sequence and the stops holding them (ties impossible when sequences are unique)."""
    seq = F.col("stop_sequence")
    return (stop_times.where(F.col("trip_id").isNotNull())
            .groupBy("trip_id").agg(
                F.min(seq).alias("min_seq"), F.max(seq).alias("max_seq"),
                F.min_by("stop_id", F.struct(seq, F.col("stop_id"))).alias("first_stop"),
                F.max_by("stop_id", F.struct(seq, F.col("stop_id"))).alias("last_stop"),
            ))


def visit_position(stop_times: DataFrame, extent: DataFrame | None = None) -> DataFrame:
    """Attach max_seq, relative position seq/max_seq and first/last flags to each visit.

    First = the trip's smallest sequence (equal to ``seq == 1`` for feeds that start at 1).
    """
    ext = extent if extent is not None else trip_extent(stop_times)
    j = stop_times.join(ext.select("trip_id", "min_seq", "max_seq"), on="trip_id", how="inner")
    seq = F.col("stop_sequence")
    return j.withColumns({
        "seq_pct": seq / F.col("max_seq"),
        "is_first": (seq == F.col("min_seq")).cast("int"),
        "is_last": (seq == F.col("max_seq")).cast("int"),
    })


def route_length(extent: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """Representative route length: max over the route's trips of first-stop -> last-stop distance.

    A route with no measurable trip (endpoints without coordinates) has no length
    and no row.
    """
    a = stops.select(F.col("stop_id").alias("first_stop"), F.col("stop_lat").alias("lat1"),
                     F.col("stop_lon").alias("lon1"))
    b = stops.select(F.col("stop_id").alias("last_stop"), F.col("stop_lat").alias("lat2"),
                     F.col("stop_lon").alias("lon2"))
    t = extent.join(trips.select("trip_id", "route_id"), "trip_id").join(a, "first_stop").join(b, "last_stop")
    km = haversine_km("lat1", "lon1", "lat2", "lon2")
    return t.groupBy("route_id").agg(F.max(km).alias("route_len_km")).where(F.col("route_len_km").isNotNull())


def stop_service_measures(stop_times: DataFrame, trips: DataFrame, stops: DataFrame,
                          long_km: float = LONG_ROUTE_KM) -> DataFrame:
    """Per-stop service measures by two levels of partial aggregation.

    ``trips`` must carry route_id, direction_id (0 to 62; feeds use 0 and 1) and
    days_per_week; visits of other trips drop out in the first join, by the key
    that also gives each trip's extent. Visits then shrink to (stop, route) before
    they meet the route lengths, and to the stop after that, so no distinct count
    expands them.

    weekly_departures  sum of days_per_week over visits (final stops count too)
    num_routes_served  distinct routes; num_directions distinct directions
    is_terminal        1 when the stop is first or last on any trip
    avg_dwell_time_sec mean(departure - arrival)
    service_span_hours (max departure - min departure) / 3600
    avg_stop_sequence_pct mean(seq / max_seq)
    avg/max_route_length_km over visits; pct_long_distance = share of the
    stop's distinct routes longer than ``long_km``.
    """
    seq = F.col("stop_sequence")
    kept = stop_times.join(trips.select("trip_id", "route_id", "direction_id", "days_per_week"), "trip_id")
    extent = trip_extent(kept)
    lengths = route_length(extent, trips, stops)
    visits = visit_times(kept).join(extent.select("trip_id", "min_seq", "max_seq"), "trip_id")
    has_route = F.col("route_id").isNotNull()
    by_route = visits.where(F.col("stop_id").isNotNull()).groupBy("stop_id", "route_id").agg(
        F.sum("days_per_week").alias("days"), F.count(F.lit(1)).alias("n"),
        F.max(((seq == F.col("min_seq")) | (seq == F.col("max_seq"))).cast("int")).alias("terminal"),
        F.sum("dwell_sec").alias("dwell"), F.count("dwell_sec").alias("dwells"),
        F.min("dep_sec").alias("dep_lo"), F.max("dep_sec").alias("dep_hi"),
        F.sum(seq / F.col("max_seq")).alias("pct"), F.count(seq / F.col("max_seq")).alias("pcts"),
        F.bit_or(F.expr("shiftleft(1L, cast(direction_id as int))")).alias("directions"))
    km = F.col("route_len_km")
    agg = by_route.join(lengths, "route_id", "left").groupBy("stop_id").agg(
        F.coalesce(F.sum("days"), F.lit(0)).cast("bigint").alias("weekly_departures"),
        F.count("route_id").alias("num_routes_served"),
        F.max("terminal").alias("is_terminal"),
        F.try_divide(F.sum("dwell"), F.sum("dwells")).alias("avg_dwell_time_sec"),
        ((F.max("dep_hi") - F.min("dep_lo")) / 3600.0).alias("service_span_hours"),
        F.try_divide(F.sum("pct"), F.sum("pcts")).alias("avg_stop_sequence_pct"),
        F.coalesce(F.bit_count(F.bit_or("directions")), F.lit(0)).cast("bigint").alias("num_directions"),
        F.try_divide(F.sum(km * F.col("n")), F.sum(F.when(km.isNotNull(), F.col("n")))).alias("avg_route_length_km"),
        F.max(km).alias("max_route_length_km"),
        F.try_divide(F.count(F.when(has_route & (km > long_km), 1)), F.count("route_id")).alias("pct_long_distance"),
    )
    return agg.join(stops, "stop_id", "left")


def stop_long_share(stop_times: DataFrame, trips: DataFrame, stops: DataFrame, long_km: float = LONG_ROUTE_KM) -> DataFrame:
    """Share of a stop's distinct routes whose representative length exceeds ``long_km``.

    Dedupe to (stop, route) first, then average a 0/1 flag; routes without a
    length count as not long.
    """
    ext = trip_extent(stop_times)
    rlen = route_length(ext, trips, stops)
    pairs = (stop_times.where(F.col("stop_id").isNotNull()).select("trip_id", "stop_id")
             .join(trips.select("trip_id", "route_id"), "trip_id")
             .select("stop_id", "route_id").distinct()
             .join(rlen, "route_id", "left"))
    flag = F.when(F.col("route_len_km") > long_km, 1.0).otherwise(0.0)
    return pairs.groupBy("stop_id").agg(F.avg(flag).alias("pct_long_distance"),
                                        F.count(F.lit(1)).alias("n_routes"))


def entity_rollup(stop_measures: DataFrame, stop_entity: DataFrame, rules: dict[str, str],
                  entity_col: str = "entity_id") -> DataFrame:
    """Combine several stops mapped to one entity with a per-column rule (mean / max / sum / min)."""
    fns = {"mean": F.avg, "max": F.max, "sum": F.sum, "min": F.min}
    j = stop_measures.join(stop_entity, "stop_id", "inner").where(F.col(entity_col).isNotNull())
    return j.groupBy(entity_col).agg(*[fns[r](c).alias(c) for c, r in rules.items()],
                                     F.count(F.lit(1)).alias("n_stops"))


def route_membership_flag(entities: DataFrame, stop_entity: DataFrame, stop_times: DataFrame,
                          trips: DataFrame, routes: DataFrame, flag_name: str,
                          entity_col: str = "entity_id") -> DataFrame:
    """1 when any trip of the given routes calls at a stop mapped to the entity, else 0.

    routes -> trips (semi) -> stop_times (semi) -> distinct stops -> entities.
    """
    t = trips.join(routes.select("route_id"), "route_id", "left_semi")
    stops_on = stop_times.join(t.select("trip_id"), "trip_id", "left_semi").select("stop_id").distinct()
    ents = stop_entity.join(stops_on, "stop_id", "left_semi").select(entity_col).distinct().withColumn(
        flag_name, F.lit(1))
    return entities.join(ents, entity_col, "left").withColumn(flag_name, F.coalesce(F.col(flag_name), F.lit(0)))
