"""Composite jobs: each returns the joined table that a user of the library asks for in one call.

They compose the operators; inputs are DataFrames with the column names given
in each docstring, and an input that is None stands for a source that is not
there: its columns are NULL (or 0 where a count of nothing is meant).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.functions import text as T
from geodemand.functions.constants import (COORD_MATCH_KM, FACILITY_RADIUS_KM, FUZZY_IN_BLOCK_SCORE, MAJOR_CITY_POP, METRO_FALLBACK_KM,
                                           METRO_RADIUS_KM, NEARBY_RADIUS_KM, STOP_COORD_MATCH_KM, STOP_FUZZY_SCORE, WEIGHT_RADII_KM)
from geodemand.operators import schedule as S
from geodemand.operators import spatial as SP
from geodemand.operators.matching import cascade, similarity_join
from geodemand.operators.rows import first_non_null, ordered_text, spread


def _right(df: DataFrame, key: str, *carry: str) -> DataFrame:
    return df.select(key, F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), *carry)


# ---- resolution ------------------------------------------------------------------------------

def _named(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its normalised city name, unless it brings one."""
    return df if "city_norm" in df.columns else df.withColumn("city_norm", T.normalise_city(T.extract_city(name)))


def _coded(c: str) -> Column:
    return F.when(F.col(c).isin(1, 2), 1).otherwise(0)


def resolve_observations(observations: DataFrame, sites: DataFrame, overrides: dict | None = None, *, coord_km: float = COORD_MATCH_KM,
                         fuzzy_score: float = FUZZY_IN_BLOCK_SCORE) -> DataFrame:
    """(obs_id, match_id, match_method): the site of every observation and the tier that found it.

    Tiers: an override of the raw name; no site in the observation's state (no
    match); the nearest site of its state within ``coord_km``, unless the nearest
    site of all lies in another state; the best city name of its state with
    ``fuzzy_score`` or more; unmatched. ``overrides`` is a parameter table of the
    job. ``observations``: obs_id, raw_name, state, lat, lon; ``sites``: site_id,
    name, state, lat, lon; either may bring a ``city_norm`` of its own.
    """
    spark = observations.sparkSession
    id_kind = sites.schema["site_id"].dataType
    given = spark.createDataFrame(list((overrides or {}).items()), f"raw_name string, match_id {id_kind.simpleString()}")
    named, known = _named(spread(observations, "obs_id"), "raw_name").checkpoint(), _named(sites, "name")
    observations = named
    right = sites.select("site_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("state").alias("r_state"))
    near = SP.nearest_unbounded(observations.select("obs_id", "lat", "lon"), right, left_id="obs_id", right_id="site_id", carry=["r_state"])
    flagged = observations.join(near, "obs_id", "left").select(
        "obs_id", (F.col("site_id").isNotNull() & ~F.col("r_state").eqNullSafe(F.col("state"))).alias("suspect"))

    def override(rows):
        return rows.join(F.broadcast(given), "raw_name").withColumn("match_method", F.lit("override"))

    def no_state(rows):
        states = sites.select("state").dropna().distinct()
        return rows.join(states, "state", "left_anti").select(
            "obs_id", F.lit(None).cast(id_kind).alias("match_id"), F.lit("no_state_candidates").alias("match_method"))

    def coordinates(rows):
        trusted = rows.join(flagged.where(~F.col("suspect")), "obs_id").select("obs_id", "lat", "lon", "state")
        hit = SP.nearest_within(trusted, right, coord_km, left_id="obs_id", right_id="site_id", block=[("state", "r_state")])
        return hit.select("obs_id", F.col("site_id").alias("match_id"), F.format_string("coord(%.2fkm)", "dist_km").alias("match_method"))

    def names(rows):
        hit = similarity_join(rows, known.withColumnRenamed("state", "r_state"), left_id="obs_id", left_text="city_norm", right_id="site_id",
                              right_text="city_norm", threshold=fuzzy_score, block=("state", "r_state"))
        return hit.select("obs_id", F.col("site_id").alias("match_id"),
                          F.format_string("fuzzy(%d)", F.bround("score", 0).cast("int")).alias("match_method"))

    return cascade(named, "obs_id", [("override", override), ("no_state", no_state), ("coord", coordinates), ("fuzzy", names)])


def resolve_sites(observations: DataFrame, sites: DataFrame, facts: DataFrame | None = None, overrides: dict | None = None, *,
                  flags: dict[str, str] | None = None, facts_order: str = "facility_id", rows_per_range: int = 50_000,
                  coord_km: float = COORD_MATCH_KM, fuzzy_score: float = FUZZY_IN_BLOCK_SCORE) -> DataFrame:
    """The base table: ``sites``, one row each, with what their observations add up to.

    Observations are resolved by :func:`resolve_observations`; per site their
    ``value`` is summed, their names are joined in the order of their ids, and the
    method is that of the first (" (summed)" if there are more). A site without
    coordinates takes those of its first observation. ``facts`` (site_id,
    ``facts_order`` and coded columns, several rows a site) gives each site's
    first non-NULL values; ``flags`` maps a coded column to the name of its 0/1
    flag (codes 1 and 2 are 1), NULL for sites without facts.

    Returns the columns of ``sites`` and total_value, n_obs, obs_names,
    match_method and the flags. Sites without observations have NULLs.
    """
    matched = resolve_observations(observations, sites, overrides, coord_km=coord_km, fuzzy_score=fuzzy_score)
    rows = matched.where("match_id is not null").join(observations.select("obs_id", "raw_name", "value", "lat", "lon"), "obs_id")
    rows = rows.withColumnsRenamed({"match_id": "site_id", "lat": "_lat", "lon": "_lon"}).checkpoint()
    first = F.struct("obs_id")
    sums = rows.groupBy("site_id").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_value"), F.count(F.lit(1)).alias("n_obs"),
        F.min_by("match_method", first).alias("match_method"), F.min_by("_lat", first).alias("_lat"), F.min_by("_lon", first).alias("_lon"))
    sums = sums.withColumn("match_method", F.when(F.col("n_obs") > 1, F.concat("match_method", F.lit(" (summed)"))).otherwise(F.col("match_method")))
    texts = ordered_text(rows, ["site_id"], "obs_id", "raw_name", "obs_names", rows_per_range=rows_per_range)
    out = sites.join(sums, "site_id", "left").join(texts, "site_id", "left")
    out = out.withColumns({"lat": F.coalesce("lat", "_lat"), "lon": F.coalesce("lon", "_lon")}).drop("_lat", "_lon")
    flags = flags or {}
    if facts is None:
        return out.withColumns({f: F.lit(None).cast("int") for f in flags.values()})
    coded = facts.select("site_id", facts_order, *[_coded(c).cast("int").alias(f) for c, f in flags.items()])
    return out.join(first_non_null(coded, ["site_id"], [(facts_order, True)], list(flags.values())), "site_id", "left")


def match_stops(stops: DataFrame, entities: DataFrame, *, fuzzy_score: float = STOP_FUZZY_SCORE, coord_km: float = STOP_COORD_MATCH_KM) -> DataFrame:
    """(stop_id, match_id, match_method): the entity of every stop.

    Tiers: the entity whose id is the stop's; the best name by token sets with
    ``fuzzy_score`` or more, suffixes of stop names removed; the nearest entity
    within ``coord_km``; unmatched. ``stops``: stop_id, stop_name, stop_lat,
    stop_lon; ``entities``: entity_id, name, lat, lon.
    """
    rows = stops.select("stop_id", T.clean_stop_name("stop_name").alias("clean_name"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    right = entities.select("entity_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))

    def same_id(pending):
        return pending.join(entities.select(F.col("entity_id").alias("stop_id")).distinct(), "stop_id", "left_semi").select(
            "stop_id", F.col("stop_id").cast(entities.schema["entity_id"].dataType).alias("match_id"), F.lit("exact_code").alias("match_method"))

    def names(pending):
        hit = similarity_join(pending, entities.select("entity_id", "name"), left_id="stop_id", left_text="clean_name", right_id="entity_id",
                              right_text="name", threshold=fuzzy_score, scorer="token_set")
        return hit.select("stop_id", F.col("entity_id").alias("match_id"),
                          F.format_string("fuzzy_name(score=%d)", F.bround("score", 0).cast("int")).alias("match_method"))

    def coordinates(pending):
        hit = SP.nearest_within(pending.select("stop_id", "lat", "lon"), right, coord_km, left_id="stop_id", right_id="entity_id")
        return hit.select("stop_id", F.col("entity_id").alias("match_id"), F.format_string("coord(dist=%.2fkm)", "dist_km").alias("match_method"))

    return cascade(rows, "stop_id", [("exact", same_id), ("fuzzy", names), ("coord", coordinates)])


# ---- features --------------------------------------------------------------------------------

def spatial_features(sites: DataFrame, places: DataFrame | None, *, near_km: float = METRO_RADIUS_KM, fallback_km: float = METRO_FALLBACK_KM,
                     major_pop: int = MAJOR_CITY_POP, sites_km: float = NEARBY_RADIUS_KM) -> DataFrame:
    """``sites`` (site_id, lat, lon, ...) with metro_pop, distance_to_nearest_major_km and num_sites_nearby.

    ``places``: place_id, lat, lon, pop.
    """
    here = sites.select("site_id", "lat", "lon")
    count = SP.radius_count(here, _right(sites.withColumnRenamed("site_id", "other_id"), "other_id"), sites_km, left_id="site_id",
                            out="num_sites_nearby", exclude_self=True).select("site_id", "num_sites_nearby")
    out = sites.join(count, "site_id", "left")
    if places is None:
        return out.withColumns({"metro_pop": F.lit(None).cast("long"), "distance_to_nearest_major_km": F.lit(None).cast("double")})
    metro = SP.radius_max_with_fallback(here, _right(places, "place_id", "pop"), "pop", left_id="site_id", radius_km=near_km,
                                        fallback_km=fallback_km).select("site_id", "metro_pop")
    major = SP.nearest_distance(here, _right(places.where(F.col("pop") > major_pop), "place_id"), left_id="site_id",
                                right_id="place_id", out="distance_to_nearest_major_km").select("site_id", "distance_to_nearest_major_km")
    return out.join(metro, "site_id", "left").join(major, "site_id", "left")


def weight_features(sites: DataFrame, places: DataFrame | None, radii: tuple[float, ...] = (*WEIGHT_RADII_KM, 50)) -> DataFrame:
    """``sites`` with the sum of ``pop`` of the places within each radius (0 without any)."""
    if places is None:
        return sites.withColumns({f"weight_within_{r}km": F.lit(0).cast("long") for r in radii})
    sums = SP.radius_sum_multi(sites.select("site_id", "lat", "lon"), _right(places, "place_id", "pop"), "pop", list(radii),
                               left_id="site_id").drop("lat", "lon")
    return sites.join(sums, "site_id", "left")


def area_features(sites: DataFrame, areas: DataFrame | None, stats: DataFrame | None, *, within_km: float = 300.0) -> DataFrame:
    """``sites`` with the area_fips of the nearest area within the limit and that area's statistics.

    ``areas``: area_fips, r_lat, r_lon; ``stats``: area_fips and any measures.
    """
    if areas is None:
        out = sites.withColumn("area_fips", F.lit(None).cast("string"))
    else:
        near = SP.nearest_within(sites.select("site_id", "lat", "lon"), areas, within_km, left_id="site_id", right_id="area_fips")
        out = sites.join(near.select("site_id", "area_fips"), "site_id", "left")
    return out if stats is None else out.join(stats, "area_fips", "left")


def visitor_features(sites: DataFrame, site_area: DataFrame, visitors: DataFrame | None) -> DataFrame:
    """``sites`` with the area_code of ``site_area`` (site_id, area_code) and the visitors of their area.

    ``visitors``: area_code, visitors, n_entries, as the containment match gives
    them; sites in an area without entries have NULL.
    """
    out = sites.join(site_area, "site_id", "left")
    if visitors is None:
        return out.withColumns({"visitors": F.lit(None).cast("double"), "n_entries": F.lit(None).cast("long")})
    return out.join(visitors, "area_code", "left")


def feature_defaults(df: DataFrame, *, flags: tuple[str, ...] = (), zeros: tuple[str, ...] = (), missing: tuple[str, ...] = (),
                     categories: dict[str, str] | None = None, target: str | None = None) -> DataFrame:
    """The station table as a model reads it, whatever columns it came with.

    ``flags`` become 0/1 integers (NULL or absent: 0), ``zeros`` doubles (NULL or
    absent: 0.0), ``missing`` stay NULL (absent: NULL doubles), ``categories`` take
    their most frequent value for NULL (smallest of equals; the given word for a
    column that is absent or all NULL). With a ``target``, ``log_target`` is its log1p.
    """
    out = df
    for c, kind, value in [*((c, "int", 0) for c in flags), *((c, "double", 0.0) for c in zeros)]:
        out = out.withColumn(c, F.coalesce(F.col(c).cast(kind), F.lit(value)) if c in df.columns else F.lit(value).cast(kind))
    for c in missing:
        if c not in df.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    for c, word in (categories or {}).items():
        if c not in df.columns:
            out = out.withColumn(c, F.lit(word))
            continue
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        best = counts.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).first()[0]
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(word if best is None else best)))
    return out.withColumn("log_target", F.log1p(F.col(target))) if target and target in df.columns else out


def schedule_features(entities: DataFrame, stop_entity: DataFrame | None, stop_times: DataFrame | None, trips: DataFrame | None,
                      stops: DataFrame | None, rules: dict[str, str], *, entity_col: str = "entity_id") -> DataFrame:
    """``entities`` with their stops' service measures combined by ``rules`` (mean, max, sum, min) and n_stops.

    Without a ``stop_entity`` (stop_id, entity_id) table the stops are matched to
    the entities (entity_id, name, lat, lon) by :func:`match_stops`. Entities
    without a served stop, or without a timetable at all, have NULL measures.
    """
    if stop_times is None or trips is None or stops is None:
        return entities.withColumns({c: F.lit(None).cast("double") for c in rules} | {"n_stops": F.lit(None).cast("long")})
    if stop_entity is None:
        found = match_stops(stops, entities.withColumnRenamed(entity_col, "entity_id"))
        stop_entity = found.where("match_id is not null").select("stop_id", F.col("match_id").alias(entity_col))
    measures = S.stop_service_measures(stop_times, trips, stops)
    return entities.join(S.entity_rollup(measures, stop_entity, rules, entity_col=entity_col), entity_col, "left")


def candidate_features(candidates: DataFrame, places: DataFrame, sites: DataFrame, areas: DataFrame | None,
                       facilities: DataFrame | None, flags: tuple[str, ...] = (), *, area_km: float = 300.0,
                       flag_km: float = FACILITY_RADIUS_KM) -> DataFrame:
    """``candidates`` (code, lat, lon, ...) with the features of sites: metro_pop, distance_to_nearest_major_km,
    num_sites_nearby, area_fips and any-of ``flags`` of the facilities around (0 without facilities).

    ``areas``: area_fips, r_lat, r_lon; ``facilities``: facility_id, lat, lon and the flags.
    """
    here = candidates.select("code", "lat", "lon")
    out = candidates
    metro = SP.radius_max_with_fallback(here, _right(places, "place_id", "pop"), "pop", left_id="code")
    major = SP.nearest_distance(here, _right(places.where(F.col("pop") > MAJOR_CITY_POP), "place_id"), left_id="code", right_id="place_id",
                                out="distance_to_nearest_major_km")
    near = SP.radius_count(here, _right(sites, "site_id"), NEARBY_RADIUS_KM, left_id="code", out="num_sites_nearby")
    for part, column in ((metro, "metro_pop"), (major, "distance_to_nearest_major_km"), (near, "num_sites_nearby")):
        out = out.join(part.select("code", column), "code", "left")
    if areas is None:
        out = out.withColumn("area_fips", F.lit(None).cast("string"))
    else:
        area = SP.nearest_within(here, areas, area_km, left_id="code", right_id="area_fips").select("code", "area_fips")
        out = out.join(area, "code", "left")
    if facilities is None:
        return out.withColumns({f: F.lit(0) for f in flags})
    found = SP.radius_flags(here, _right(facilities, "facility_id", *flags), list(flags), flag_km, left_id="code")
    return out.join(found.select("code", *flags), "code", "left")
