"""Area enrichment queries: dirty statistics, outer joins, key padding, two-hop joins, key caches, delimited scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geodemand.functions.geo import haversine_sql, round6
from geodemand.functions.text import zfill
from geodemand.operators import enrich as EN
from geodemand.operators import spatial as SP
from geodemand.plans.fixture_sql import r6, with_fx
from geodemand.plans.fixtures import Fixtures
from geodemand.plans.q_spatial import area_centroids
from geodemand.plans.registry import query
from geodemand.session import scratch_path
from geodemand.sources.readers import read_delimited, write_delimited

GEO_ID_PATTERN = "^[0-9]{7}US[0-9]+$"
_NUM_SQL = "'^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$'"


def area_text(fx):
    """Per-customer area statistics as dirty text (markers '-', 'N', '250,000+')."""
    k = F.col("c_custkey")
    c = fx.t("customer")
    return c.select(
        F.concat(F.lit("0500000US"), F.lpad(k.cast("string"), 5, "0")).alias("GEO_ID"),
        F.when(k % 7 == 0, F.lit("-")).otherwise((1000 + (k * 13) % 5000).cast("string")).alias("total_raw"),
        F.when(k % 5 == 0, F.lit("N")).otherwise((100 + (k * 3) % 900).cast("string")).alias("drove_raw"),
        ((k * 11) % 300).cast("string").alias("transit_raw"),
        F.when(k % 6 == 0, F.lit("250,000+")).otherwise((30000 + (k * 1000) % 90000).cast("string")).alias(
            "income_raw"),
        F.col("c_acctbal"), F.col("c_mktsegment"),
    )


_AREA_CTES = """
area_text AS (select '0500000US' || lpad(cast(c_custkey as varchar), 5, '0') as GEO_ID,
  case when c_custkey % 7 = 0 then '-' else cast(1000 + (c_custkey*13) % 5000 as varchar) end as total_raw,
  case when c_custkey % 5 = 0 then 'N' else cast(100 + (c_custkey*3) % 900 as varchar) end as drove_raw,
  cast((c_custkey*11) % 300 as varchar) as transit_raw,
  case when c_custkey % 6 = 0 then '250,000+' else cast(30000 + (c_custkey*1000) % 90000 as varchar) end as income_raw,
  c_acctbal, c_mktsegment from customer)
"""


def _num_sql(x):
    return f"(case when regexp_matches({x}, {_NUM_SQL}) then try_cast(trim({x}) as double) end)"


def clean_area_stats(df):
    d = EN.drop_label_rows(df, "GEO_ID", GEO_ID_PATTERN)
    d = d.select(F.expr("right(GEO_ID, 5)").alias("area_fips"), EN.to_number("total_raw").alias("total"),
                 EN.to_number("drove_raw").alias("drove"), EN.to_number("transit_raw").alias("transit"),
                 EN.to_number("income_raw").alias("median_income"))
    return EN.shares(d, "total", {"share_drove": "drove", "share_transit": "transit"})


@query("area_stats_clean", with_fx(f"""
select area_fips, total, drove, transit, median_income, {r6('share_drove')} as share_drove,
  {r6('share_transit')} as share_transit from (
 select right(GEO_ID, 5) as area_fips, {_num_sql('total_raw')} as total, {_num_sql('drove_raw')} as drove,
   {_num_sql('transit_raw')} as transit, {_num_sql('income_raw')} as median_income,
   {_num_sql('drove_raw')} / nullif({_num_sql('total_raw')}, 0) as share_drove,
   {_num_sql('transit_raw')} / nullif({_num_sql('total_raw')}, 0) as share_transit
 from area_text where regexp_matches(GEO_ID, '{GEO_ID_PATTERN}')) x
""", _AREA_CTES))
def area_stats_clean(spark, sf_dir):
    d = clean_area_stats(area_text(Fixtures(spark, sf_dir)))
    return d.select("area_fips", "total", "drove", "transit", "median_income",
                    round6("share_drove").alias("share_drove"), round6("share_transit").alias("share_transit"))


@query("area_stats_outer", with_fx(f"""
select coalesce(a.area_fips, b.area_fips) as area_fips, a.total, b.median_income
from (select right(GEO_ID, 5) as area_fips, {_num_sql('total_raw')} as total from area_text where c_acctbal > 0) a
full outer join (select right(GEO_ID, 5) as area_fips, {_num_sql('income_raw')} as median_income from area_text
  where c_mktsegment <> 'BUILDING') b on a.area_fips = b.area_fips
""", _AREA_CTES))
def area_stats_outer(spark, sf_dir):
    t = area_text(Fixtures(spark, sf_dir))
    a = t.where(F.col("c_acctbal") > 0).select(F.expr("right(GEO_ID, 5)").alias("area_fips"),
                                               EN.to_number("total_raw").alias("total"))
    b = t.where(F.col("c_mktsegment") != "BUILDING").select(F.expr("right(GEO_ID, 5)").alias("area_fips"),
                                                            EN.to_number("income_raw").alias("median_income"))
    return a.join(b, "area_fips", "full_outer").select("area_fips", "total", "median_income")


def delineation(fx):
    """County -> area: padded 2+3 digit county key; metro division code preferred over the base area code."""
    c = fx.t("customer")
    k = F.col("c_custkey")
    division = F.when(k % 4 == 0, (20000 + F.col("c_nationkey")).cast("string"))
    return c.select(F.col("c_custkey").alias("place_id"),
                    F.concat(zfill(F.col("c_nationkey"), 2), zfill(k % 1000, 3)).alias("county_fips"),
                    F.coalesce(division, (10000 + F.col("c_nationkey") * 100).cast("string")).alias("area_code"))


_DELIN_SQL = """
delin AS (select c_custkey as place_id, lpad(cast(c_nationkey as varchar), 2, '0') || lpad(cast(c_custkey % 1000 as varchar), 3, '0')
  as county_fips, coalesce(case when c_custkey % 4 = 0 then cast(20000 + c_nationkey as varchar) end,
  cast(10000 + c_nationkey*100 as varchar)) as area_code from customer)
"""


@query("area_delineation", with_fx("select place_id, county_fips, area_code from delin", _DELIN_SQL))
def area_delineation(spark, sf_dir):
    return delineation(Fixtures(spark, sf_dir))


@query("two_hop_enrich", with_fx("""
select p.place_id, k.county_fips, a.area_code, m.area_places
from fx_places p
left join (select place_id, nullif(case when place_id % 13 = 0 then 'None' else county_fips end, 'None') as county_fips
           from delin) k on k.place_id = p.place_id
left join (select county_fips, min(area_code) as area_code from delin group by county_fips) a on a.county_fips = k.county_fips
left join (select area_code, count(*) as area_places from delin group by area_code) m on m.area_code = a.area_code
""", _DELIN_SQL))
def two_hop_enrich(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    d = delineation(fx)
    key_map = d.select("place_id", F.when(F.col("place_id") % 13 == 0, F.lit("None"))
                       .otherwise(F.col("county_fips")).alias("county_fips"))
    area_map = d.groupBy("county_fips").agg(F.min("area_code").alias("area_code"))
    measures = d.groupBy("area_code").agg(F.count(F.lit(1)).alias("area_places"))
    r = EN.enrich_two_hop(fx.places().select("place_id"), key_map, area_map, measures, "place_id", "county_fips",
                          "area_code")
    return r.select("place_id", "county_fips", "area_code", "area_places")


@query("key_cache_upsert", with_fx("""
select place_id, '99999' as area_fips from fx_places p join customer c on c.c_custkey = p.place_id
where c.c_mktsegment = 'AUTOMOBILE'
union all
select p.place_id, n.area_fips from fx_places p join customer c on c.c_custkey = p.place_id
left join (select place_id, area_fips from (
   select p.place_id, a.area_fips, row_number() over (partition by p.place_id order by HAV_PA, a.area_fips) as rn
   from fx_places p join areas a on HAV_PA <= 300.0e0) x where rn = 1) n on n.place_id = p.place_id
where c.c_mktsegment <> 'AUTOMOBILE'
""", """
areas AS (select lpad(cast(state as varchar(10)), 5, '0') as area_fips, avg(lat) as lat, avg(lon) as lon
  from fx_sites where state is not null group by state)
""").replace("HAV_PA", haversine_sql("p.lat", "p.lon", "a.lat", "a.lon")))
def key_cache_upsert(spark, sf_dir):
    """Existing cache (one segment, stale marker values) + resolution of only the missing ids."""
    fx = Fixtures(spark, sf_dir)
    places = fx.places().join(fx.t("customer").select(F.col("c_custkey").alias("place_id"), "c_mktsegment"),
                              "place_id")
    cache = places.where(F.col("c_mktsegment") == "AUTOMOBILE").select("place_id", F.lit("99999").alias("area_fips"))
    cents = area_centroids(fx.sites())

    def resolver(todo):
        pts = todo.join(places.select("place_id", "lat", "lon"), "place_id")
        n = SP.nearest_within(pts, cents, 300.0, left_id="place_id", right_id="area_fips")
        return pts.join(n, "place_id", "left").select("place_id", "area_fips")

    return EN.upsert_keys(cache, places.select("place_id"), resolver, "place_id").select("place_id", "area_fips")


@query("scan_delimited", with_fx("select obs_id, raw_name, value, state from fx_obs"))
def scan_delimited(spark, sf_dir):
    """Round trip through a UTF-16 tab-separated file with padded header names, read back and trimmed."""
    fx = Fixtures(spark, sf_dir)
    src = fx.obs().select(F.col("obs_id").alias(" obs_id "), F.col("raw_name").alias("raw_name "),
                          F.col("value").alias(" value"), F.col("state").alias("state"))
    path = write_delimited(src, scratch_path(spark, f"scan_delimited/{uuid.uuid4().hex}"))
    schema = "obs_id long, raw_name string, value double, state int"
    df = read_delimited(spark, path, sep="\t", encoding="UTF-16")
    return df.select(*[F.col(n).cast(t) for n, t in (x.split() for x in schema.split(", "))])
