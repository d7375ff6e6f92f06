"""Entity resolution queries: name clean-up, fuzzy and cascaded matching, roll-ups, containment matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand import jobs
from geodemand.functions import text as T
from geodemand.functions.constants import COORD_MATCH_KM, FUZZY_IN_BLOCK_SCORE, STATE_ABBR, STOP_COORD_MATCH_KM, \
    STOP_FUZZY_SCORE
from geodemand.functions.geo import haversine_sql, round6
from geodemand.operators import spatial as SP
from geodemand.operators.contains import contains_first
from geodemand.operators.enrich import map_constant
from geodemand.operators.matching import similarity_join
from geodemand.operators.rows import first_non_null, ordered_text, spread
from geodemand.plans.fixture_sql import r6, with_fx
from geodemand.plans.fixtures import Fixtures
from geodemand.plans.q_spatial import _NEAREST_SQL, match_in_block, nearest_any_block
from geodemand.plans.registry import query

EXCLUDE_PATTERN = "(?i)lot 1[0-9]+\\)|auto train"
OVERRIDE_NAME = "Supplier#000000001 Station, XX"
OVERRIDE_SITE = 2
TOP_VISITOR_ENTRIES = 50
# Area of an entry's city where its title would not be found, or None for entries to leave out: a parameter of the job.
AREA_OVERRIDES = {"supplier 000000005": "00002", "supplier 000000007": None, "supplier 000000011": "00003"}


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- name clean-up ----------------------------------------------------------------------

def obs_names(obs):
    """Split '#' into its own token, take the city part, normalise (both sides get the same treatment)."""
    city_raw = T.extract_city("raw_name")
    return spread(obs, "obs_id").withColumns({"city_raw": city_raw}).withColumn(
        "city_norm", T.normalise_city(F.replace(F.col("city_raw"), F.lit("#"), F.lit(" #"))))


def site_names(sites):
    return sites.withColumn("city_norm", T.normalise_city(F.replace(T.extract_city("name"), F.lit("#"), F.lit(" #"))))


def _norm_sql(x: str) -> str:
    s = f"regexp_replace({x}, '\\s*\\([^)]*\\)', '', 'g')"
    s = f"regexp_replace({s}, ',.*$', '')"
    s = f"regexp_replace(lower({s}), '^\\s+|\\s+$', '', 'g')"
    s = f"regexp_replace({s}, '\\s*(amtrak|station|depot|terminal)$', '')"
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


_CITY_RAW_SQL = ("case when regexp_extract(raw_name, '^(.+?),\\s*[A-Z]', 1) = '' then raw_name "
                 "else regexp_extract(raw_name, '^(.+?),\\s*[A-Z]', 1) end")


def _sort_tokens_sql(x: str) -> str:
    st = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"(case when {st} = '' then '' else array_to_string(list_sort(regexp_split_to_array({st}, '\\s+')), ' ') end)"


def _lcs_ctes(pairs_cte: str) -> str:
    """Bit-parallel LCS of text pairs (pid, a, b) in SQL: masks per character, one recursion step per char of b."""
    return f"""
{pairs_cte},
lcs_masks AS (select p.pid, substr(p.a, t.i, 1) as ch, sum((1::hugeint) << (t.i - 1)) as m
  from lcs_pairs p, unnest(range(1, length(p.a) + 1)) as t(i) group by p.pid, substr(p.a, t.i, 1)),
lcs_run(pid, j, v) AS (
  select pid, 0, ((1::hugeint) << length(a)) - 1 from lcs_pairs
  union all
  select l.pid, l.j + 1,
    ((l.v + (l.v & coalesce(m.m, 0::hugeint))) | (l.v - (l.v & coalesce(m.m, 0::hugeint))))
      & (((1::hugeint) << length(p.a)) - 1)
  from lcs_run l join lcs_pairs p on p.pid = l.pid
  left join lcs_masks m on m.pid = l.pid and m.ch = substr(p.b, l.j + 1, 1)
  where l.j < length(p.b)),
lcs_score AS (select p.pid, p.a, p.b, case when length(p.a) + length(p.b) = 0 then 100.0e0
    else 100.0e0 * 2.0e0 * (length(p.a) - bit_count(l.v)) / (length(p.a) + length(p.b)) end as score
  from lcs_pairs p join lcs_run l on l.pid = p.pid and l.j = length(p.b))"""


_OBS_NORM_SQL = _norm_sql("replace(city_raw, '#', ' #')")
_SITE_NORM_SQL = _norm_sql("replace(name, '#', ' #')")
_NAMED_CTES = f"""
obs_n AS (select obs_id, true_site, state, {_OBS_NORM_SQL} as city_norm
  from (select *, {_CITY_RAW_SQL} as city_raw from fx_obs) x),
site_n AS (select site_id, state, {_SITE_NORM_SQL} as city_norm from fx_sites)"""


def _words_sql(x: str) -> str:
    st = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"list_filter(list_distinct(regexp_split_to_array({st}, '\\s+')), lambda w: w <> '')"


def _token_set_ctes(pairs_sql: str) -> str:
    """token-set score of (x, y) text pairs: set algebra in list functions, LCS of the sorted differences."""
    return f"""
ts_in AS ({pairs_sql}),
ts_sets AS (select x, y, ta, tb, list_intersect(ta, tb) as inter,
    list_filter(ta, lambda w: not list_contains(tb, w)) as dab,
    list_filter(tb, lambda w: not list_contains(ta, w)) as dba
  from (select distinct x, y, {_words_sql('x')} as ta, {_words_sql('y')} as tb from ts_in) d),
ts_parts AS (select x, y, len(ta) as na, len(tb) as nb, len(inter) as ni, len(dab) as nab, len(dba) as nba,
    array_to_string(list_sort(dab), ' ') as sab, array_to_string(list_sort(dba), ' ') as sba,
    length(array_to_string(list_sort(inter), ' ')) as sect from ts_sets),
lcs_pairs AS (select row_number() over (order by a, b) as pid, a, b from (
  select distinct sab as a, sba as b from ts_parts) q),""" + _lcs_ctes("").lstrip().lstrip(",").replace(
        "\n,", "", 1) + """,
ts_score AS (select t.x, t.y, case
    when t.na = 0 or t.nb = 0 then 0.0e0
    when t.ni > 0 and (t.nab = 0 or t.nba = 0) then 100.0e0
    else (case when t.sect = 0 then best else greatest(best,
      100.0e0 - 100.0e0 * (1 + length(t.sab)) / (t.sect + t.sect + 1 + length(t.sab)),
      100.0e0 - 100.0e0 * (1 + length(t.sba)) / (t.sect + t.sect + 1 + length(t.sba))) end) end as score
  from (select p.*, case when tot = 0 then 100.0e0 else 100.0e0 - 100.0e0 * dist / tot end as best from (
      select t.*, (t.sect + case when t.sect > 0 then 1 else 0 end + length(t.sab))
                + (t.sect + case when t.sect > 0 then 1 else 0 end + length(t.sba)) as tot,
             length(t.sab) + length(t.sba) - 2 * (length(t.sab) - bit_count(l.v)) as dist
      from ts_parts t join lcs_pairs lp on lp.a = t.sab and lp.b = t.sba
      join lcs_run l on l.pid = lp.pid and l.j = length(t.sba)) p) t)"""


_STOP_CLEAN_SQL = ("regexp_replace(replace(replace(replace(raw_name, ' Amtrak Station', ''), ' Train Station', ''),"
                   " ' Station', ''), '^\\s+|\\s+$', '', 'g')")


@query("name_normalise", with_fx(f"""
select obs_id, city_raw, {_norm_sql("replace(city_raw, '#', ' #')")} as city_norm
from (select obs_id, {_CITY_RAW_SQL} as city_raw from fx_obs) x
"""))
def name_normalise(spark, sf_dir):
    o = obs_names(Fixtures(spark, sf_dir).obs())
    return o.select("obs_id", "city_raw", "city_norm")


@query("filter_name_exclude", with_fx(f"""
select obs_id, raw_name from fx_obs_gaps where not coalesce(regexp_matches(raw_name, {_sql_str(EXCLUDE_PATTERN)}), false)
"""))
def filter_name_exclude(spark, sf_dir):
    o = Fixtures(spark, sf_dir).obs_gaps()
    keep = ~F.coalesce(F.col("raw_name").rlike(EXCLUDE_PATTERN), F.lit(False))
    return o.where(keep).select("obs_id", "raw_name")


_STATE_NAMES = list(STATE_ABBR)
_STATE_VALUES_SQL = ", ".join(f"({_sql_str(k)}, {_sql_str(v)})" for k, v in STATE_ABBR.items())
_NAME_BY_INDEX_SQL = "[" + ", ".join(_sql_str(k) for k in _STATE_NAMES) + "]"


@query("state_code_map", with_fx(f"""
select o.obs_id, o.state_name, m.code as state_abbr
from (select obs_id, case when state < 20 then {_NAME_BY_INDEX_SQL}[state + 1] else 'Unknown ' || cast(state as varchar) end
        as state_name from fx_obs) o
left join (select * from (values {_STATE_VALUES_SQL}) as t(name, code)) m on m.name = o.state_name
"""))
def state_code_map(spark, sf_dir):
    o = Fixtures(spark, sf_dir).obs()
    names = F.array(*[F.lit(n) for n in _STATE_NAMES])
    o = o.withColumn("state_name", F.when(F.col("state") < 20, F.element_at(names, (F.col("state") + 1).cast("int")))
                     .otherwise(F.concat(F.lit("Unknown "), F.col("state").cast("string"))))
    r = map_constant(spark, o, "state_name", STATE_ABBR, "state_abbr")
    return r.select("obs_id", "state_name", "state_abbr")


# ---- scores -----------------------------------------------------------------------------

@query("token_sort_ratio", with_fx("""
select o.obs_id, o.true_site, sc.score from obs_n o join site_n s on s.site_id = o.true_site
join lcs_score sc on sc.a = SORT_A and sc.b = SORT_B
""".replace("SORT_A", _sort_tokens_sql("o.city_norm")).replace("SORT_B", _sort_tokens_sql("s.city_norm")),
    _NAMED_CTES + "," + _lcs_ctes(f"""
lcs_pairs AS (select row_number() over (order by a, b) as pid, a, b from (
  select distinct {_sort_tokens_sql('o.city_norm')} as a, {_sort_tokens_sql('s.city_norm')} as b
  from obs_n o join site_n s on s.site_id = o.true_site) d)"""), recursive=True))
def token_sort_ratio_q(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    o = obs_names(fx.obs()).select("obs_id", "true_site", "city_norm")
    s = site_names(fx.sites()).select(F.col("site_id").alias("true_site"), F.col("city_norm").alias("site_norm"))
    j = o.join(s, "true_site")
    return j.select("obs_id", "true_site", T.token_sort_ratio("city_norm", "site_norm").alias("score"))


@query("token_set_ratio", with_fx("""
select o.obs_id, o.true_site, ts.score
from (select obs_id, true_site, CLEAN as x from fx_obs) o join fx_sites s on s.site_id = o.true_site
join ts_score ts on ts.x = o.x and ts.y = s.name
""".replace("CLEAN", _STOP_CLEAN_SQL), _token_set_ctes(f"""
select {_STOP_CLEAN_SQL} as x, s.name as y from fx_obs o join fx_sites s on s.site_id = o.true_site"""),
    recursive=True))
def token_set_ratio_q(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    o = fx.obs().select("obs_id", "true_site", T.clean_stop_name("raw_name").alias("clean_name"))
    s = fx.sites().select(F.col("site_id").alias("true_site"), F.col("name").alias("site_name"))
    j = spread(o.join(s, "true_site"), "obs_id")
    return j.select("obs_id", "true_site", T.token_set_ratio("clean_name", "site_name").alias("score"))


def fuzzy_in_block(obs_named, sites_named, threshold=FUZZY_IN_BLOCK_SCORE):
    return similarity_join(obs_named, sites_named.withColumnRenamed("state", "r_state"), left_id="obs_id",
                           left_text="city_norm", right_id="site_id", right_text="city_norm", threshold=threshold,
                           scorer="token_sort", block=("state", "r_state"))


@query("match_fuzzy_in_block", with_fx(f"""
select obs_id, site_id, score from (
  select o.obs_id, s.site_id, sc.score,
    row_number() over (partition by o.obs_id order by sc.score desc, s.site_id) as rn
  from obs_n o join site_n s on s.state = o.state
  join lcs_score sc on sc.a = {_sort_tokens_sql('o.city_norm')} and sc.b = {_sort_tokens_sql('s.city_norm')}
  where sc.score >= {FUZZY_IN_BLOCK_SCORE}) x where rn = 1
""", _NAMED_CTES + "," + _lcs_ctes(f"""
lcs_pairs AS (select row_number() over (order by a, b) as pid, a, b from (
  select distinct {_sort_tokens_sql('o.city_norm')} as a, {_sort_tokens_sql('s.city_norm')} as b
  from obs_n o join site_n s on s.state = o.state) d)"""), recursive=True))
def match_fuzzy_in_block(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    m = fuzzy_in_block(obs_names(fx.obs()), site_names(fx.sites()))
    return m.select("obs_id", "site_id", "score")


def fuzzy_global(stops, sites, threshold=STOP_FUZZY_SCORE):
    return similarity_join(stops, sites.withColumnRenamed("name", "site_name"), left_id="obs_id",
                           left_text="clean_name", right_id="site_id", right_text="site_name",
                           threshold=threshold, scorer="token_set")


@query("match_fuzzy_global", with_fx(f"""
select obs_id, site_id, score from (
  select o.obs_id, s.site_id, ts.score, row_number() over (partition by o.obs_id order by ts.score desc, s.site_id) as rn
  from (select obs_id, CLEAN as x from fx_obs_gaps) o cross join fx_sites s
  join ts_score ts on ts.x = o.x and ts.y = s.name
  where ts.score >= {STOP_FUZZY_SCORE}) q where rn = 1
""".replace("CLEAN", _STOP_CLEAN_SQL), _token_set_ctes(f"""
select distinct {_STOP_CLEAN_SQL} as x, s.name as y from fx_obs_gaps o cross join fx_sites s"""), recursive=True))
def match_fuzzy_global(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    stops = fx.obs_gaps().select("obs_id", T.clean_stop_name("raw_name").alias("clean_name"))
    m = fuzzy_global(stops, fx.sites().select("site_id", "name"))
    return m.select("obs_id", "site_id", "score")


# ---- cascades ---------------------------------------------------------------------------

def observation_cascade(spark, fx, obs):
    """override -> no candidates in block -> nearest in block (unless suspect) -> fuzzy in block -> unmatched."""
    return jobs.resolve_observations(obs_names(obs), site_names(fx.sites()), {OVERRIDE_NAME: OVERRIDE_SITE})


_HOS_CASCADE = haversine_sql("o.lat", "o.lon", "s.lat", "s.lon")
_CASCADE_CTES = (_NEAREST_SQL.replace("OBS", "fx_obs_gaps").strip() + "," + f"""
obs_g AS (select obs_id, state, lat, lon, raw_name, {_OBS_NORM_SQL} as city_norm
  from (select *, {_CITY_RAW_SQL} as city_raw from fx_obs_gaps) x),
site_n AS (select site_id, state, {_SITE_NORM_SQL} as city_norm from fx_sites)""" + "," + _lcs_ctes(f"""
lcs_pairs AS (select row_number() over (order by a, b) as pid, a, b from (
  select distinct {_sort_tokens_sql('o.city_norm')} as a, {_sort_tokens_sql('s.city_norm')} as b
  from obs_g o join site_n s on s.state = o.state) d)""") + f""",
t1 AS (select obs_id, cast({OVERRIDE_SITE} as bigint) as match_id, 'override' as match_method from obs_g
  where raw_name = '{OVERRIDE_NAME}'),
p1 AS (select * from obs_g where obs_id not in (select obs_id from t1)),
t2 AS (select obs_id, cast(null as bigint) as match_id, 'no_state_candidates' as match_method from p1
  where state is null or state not in (select state from fx_sites where state is not null)),
p2 AS (select * from p1 where obs_id not in (select obs_id from t2)),
t3 AS (select obs_id, site_id as match_id, 'coord(' || printf('%.2f', d) || 'km)' as match_method from (
  select o.obs_id, s.site_id, {_HOS_CASCADE} as d,
    row_number() over (partition by o.obs_id order by {_HOS_CASCADE}, s.site_id) as rn
  from p2 o join sus u on u.obs_id = o.obs_id and not u.coord_suspect
  join fx_sites s on s.state = o.state and {_HOS_CASCADE} <= {COORD_MATCH_KM}e0) x where rn = 1),
p3 AS (select * from p2 where obs_id not in (select obs_id from t3)),
t4 AS (select obs_id, site_id as match_id, 'fuzzy(' || cast(cast(round_even(score, 0) as int) as varchar) || ')'
    as match_method from (
  select o.obs_id, s.site_id, sc.score, row_number() over (partition by o.obs_id order by sc.score desc, s.site_id) as rn
  from p3 o join site_n s on s.state = o.state
  join lcs_score sc on sc.a = {_sort_tokens_sql('o.city_norm')} and sc.b = {_sort_tokens_sql('s.city_norm')}
  where sc.score >= {FUZZY_IN_BLOCK_SCORE}) x where rn = 1),
casc AS (select * from t1 union all select * from t2 union all select * from t3 union all select * from t4
  union all select obs_id, cast(null as bigint), 'unmatched' from p3 where obs_id not in (select obs_id from t4))""")


@query("match_cascade", with_fx("select obs_id, match_id, match_method from casc", _CASCADE_CTES, recursive=True))
def match_cascade(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return observation_cascade(spark, fx, fx.obs_gaps())


_H2 = haversine_sql("o.lat", "o.lon", "s.lat", "s.lon")
_EXACT_FIRST_CTES = _token_set_ctes(f"""
select distinct {_STOP_CLEAN_SQL} as x, s.name as y from fx_obs_gaps o cross join fx_sites s""") + f""",
g AS (select obs_id, lat, lon, {_STOP_CLEAN_SQL} as x from fx_obs_gaps),
e1 AS (select obs_id, obs_id as match_id, 'exact_code' as match_method from g
  where obs_id in (select site_id from fx_sites)),
q1 AS (select * from g where obs_id not in (select obs_id from e1)),
e2 AS (select obs_id, site_id as match_id,
    'fuzzy_name(score=' || cast(cast(round_even(score, 0) as int) as varchar) || ')' as match_method from (
  select o.obs_id, s.site_id, ts.score, row_number() over (partition by o.obs_id order by ts.score desc, s.site_id) as rn
  from q1 o cross join fx_sites s join ts_score ts on ts.x = o.x and ts.y = s.name
  where ts.score >= {STOP_FUZZY_SCORE}) z where rn = 1),
q2 AS (select * from q1 where obs_id not in (select obs_id from e2)),
e3 AS (select obs_id, site_id as match_id, 'coord(dist=' || printf('%.2f', d) || 'km)' as match_method from (
  select o.obs_id, s.site_id, {_H2} as d, row_number() over (partition by o.obs_id order by {_H2}, s.site_id) as rn
  from q2 o join fx_sites s on {_H2} <= {STOP_COORD_MATCH_KM}e0) z where rn = 1),
casc2 AS (select * from e1 union all select * from e2 union all select * from e3
  union all select obs_id, cast(null as bigint), 'unmatched' from q2 where obs_id not in (select obs_id from e3))"""


@query("match_cascade_exact_first", with_fx("select obs_id, match_id, match_method from casc2", _EXACT_FIRST_CTES,
                                            recursive=True))
def match_cascade_exact_first(spark, sf_dir):
    """exact id -> global token-set fuzzy on cleaned names -> nearest within 2 km -> unmatched."""
    fx = Fixtures(spark, sf_dir)
    stops = fx.obs_gaps().select(F.col("obs_id").alias("stop_id"), F.col("raw_name").alias("stop_name"), F.col("lat").alias("stop_lat"),
                                 F.col("lon").alias("stop_lon"))
    entities = fx.sites().select(F.col("site_id").alias("entity_id"), "name", "lat", "lon")
    return jobs.match_stops(stops, entities).withColumnRenamed("stop_id", "obs_id")


@query("match_breakdown", with_fx("""
select regexp_extract(match_method, '^([a-z_]+)', 1) as method_prefix, count(*) as n from casc group by 1
""", _CASCADE_CTES, recursive=True))
def match_breakdown(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    c = observation_cascade(spark, fx, fx.obs_gaps())
    prefix = F.regexp_extract("match_method", r"^([a-z_]+)", 1)
    return c.groupBy(prefix.alias("method_prefix")).agg(F.count(F.lit(1)).alias("n"))


_HOS = haversine_sql("o.lat", "o.lon", "s.lat", "s.lon")


# ---- roll-ups ---------------------------------------------------------------------------

def resolve_rollup_df(matches, obs, sites):
    """Per matched site: sum, count, first coordinates, ' + '-joined names in order, summed-label suffix."""
    j = matches.join(obs.select("obs_id", "raw_name", "value", "lat", "lon"), "obs_id").checkpoint()
    first = F.struct(F.col("obs_id"))
    agg = j.where(F.col("site_id").isNotNull()).groupBy("site_id").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_value"),
        F.count(F.lit(1)).alias("n_obs"),
        F.min_by("match_method", first).alias("_m"),
        F.min_by("lat", first).alias("first_lat"), F.min_by("lon", first).alias("first_lon"),
    )
    agg = agg.withColumn("match_method", F.when(F.col("n_obs") > 1, F.concat(F.col("_m"), F.lit(" (summed)")))
                         .otherwise(F.col("_m"))).drop("_m")
    texts = ordered_text(j, ["site_id"], "obs_id", "raw_name", "obs_names")
    return sites.select("site_id").join(agg, "site_id", "left").join(texts, "site_id", "left")


@query("resolve_rollup", with_fx(f"""
select s.site_id, {r6('a.total_value')} as total_value, a.n_obs, a.obs_names,
  case when a.n_obs > 1 then a.m || ' (summed)' else a.m end as match_method, a.first_lat, a.first_lon
from fx_sites s left join (
  select site_id, coalesce(sum(value), 0.0e0) as total_value, count(*) as n_obs,
    string_agg(raw_name, ' + ' order by obs_id) as obs_names, arg_min(method, obs_id) as m,
    arg_min(lat, obs_id) as first_lat, arg_min(lon, obs_id) as first_lon
  from (select o.obs_id, o.site_id, 'coord(' || printf('%.2f', o.d) || 'km)' as method, x.raw_name, x.value, x.lat, x.lon
        from (select obs_id, site_id, d from (
           select o.obs_id, s.site_id, {_HOS} as d,
             row_number() over (partition by o.obs_id order by {_HOS}, s.site_id) as rn
           from sus o join fx_sites s on s.state = o.state and {_HOS} <= 30.0e0 where not o.coord_suspect) y
           where rn = 1) o
        join fx_obs x on x.obs_id = o.obs_id) z
  group by site_id) a on a.site_id = s.site_id
""", _NEAREST_SQL.replace("OBS", "fx_obs")))
def resolve_rollup(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    obs = fx.obs()
    flagged = nearest_any_block(obs, fx.sites())
    m = match_in_block(flagged, fx.sites(), COORD_MATCH_KM).select(
        "obs_id", "site_id", F.format_string("coord(%.2fkm)", F.col("dist_km")).alias("match_method"))
    r = resolve_rollup_df(m, obs, fx.sites())
    return r.select("site_id", round6("total_value").alias("total_value"), "n_obs", "obs_names", "match_method",
                    "first_lat", "first_lon")


@query("first_non_null", with_fx("""
select o.true_site, arg_min(g.state, g.obs_id) filter (where g.state is not null) as state,
  arg_min(g.lat, g.obs_id) filter (where g.lat is not null) as lat,
  arg_min(g.lon, g.obs_id) filter (where g.lon is not null) as lon
from fx_obs_gaps g join fx_obs o on o.obs_id = g.obs_id group by o.true_site
"""))
def first_non_null_q(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    g = fx.obs_gaps().join(fx.obs().select("obs_id", "true_site"), "obs_id")
    return first_non_null(g, ["true_site"], [("obs_id", True)], ["state", "lat", "lon"])


# ---- containment matching ---------------------------------------------------------------

def _code2(k):
    return F.concat(F.expr(f"chr(65 + {k} % 26)"), F.expr(f"chr(65 + ({k} * 7) % 26)"))


def area_titles(fx):
    s = fx.sites()
    return s.select(F.lpad(F.col("site_id").cast("string"), 5, "0").alias("area_code"), F.col("site_id").alias("ord"),
                    F.concat(F.replace(F.col("name"), F.lit("#"), F.lit(" ")), F.lit(" Area, "), _code2("state"),
                             F.lit(" MSA")).alias("area_title"))


def visitor_entries(fx):
    n_sites = fx.sites().count()
    p = fx.places()
    num = F.lpad((F.col("place_id") % F.lit(n_sites)).cast("string"), 9, "0")
    st = F.when(F.col("place_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(", "), _code2("state")))
    return p.select("place_id", F.col("pop").alias("visitors"),
                    F.concat(F.lit("Supplier "), num, st, F.lit(" MSA")).alias("msa_name"))


_CONTAINS_CTES = """
titles AS (select lpad(cast(site_id as varchar), 5, '0') as area_code, site_id as ord,
  replace(name, '#', ' ') || ' Area, ' || chr(cast(65 + state % 26 as int)) || chr(cast(65 + (state * 7) % 26 as int)) || ' MSA'
  as area_title from fx_sites),
ents AS (select place_id, pop as visitors, 'Supplier ' || lpad(cast(place_id % n.n_sites as varchar), 9, '0')
  || case when place_id % 2 = 0 then '' else ', ' || chr(cast(65 + state % 26 as int)) || chr(cast(65 + (state * 7) % 26 as int)) end
  || ' MSA' as msa_name
  from fx_places cross join (select count(*) as n_sites from fx_sites) n),
parsed AS (select place_id, visitors, msa_name,
  regexp_replace(split_part(regexp_replace(regexp_replace(msa_name, '\\s+(MSA|MD|MICRO)\\s*$', ''),
     ',?\\s+[A-Z]{2}(?:-[A-Z]{2})*\\s*$', ''), '-', 1), '^\\s+|\\s+$', '', 'g') as primary_city,
  regexp_extract(msa_name, '([A-Z]{2})(?:-[A-Z]{2})*\\s*(?:MSA|MD|MICRO|,)?\\s*$', 1) as state from ents)
"""


@query("area_name_parse", with_fx("select place_id, msa_name, primary_city, state from parsed", _CONTAINS_CTES))
def area_name_parse(spark, sf_dir):
    e = visitor_entries(Fixtures(spark, sf_dir))
    return e.select("place_id", "msa_name", T.primary_city("msa_name").alias("primary_city"),
                    T.first_state("msa_name").alias("state"))


def match_titles(entries, titles, overrides, extra):
    """``entries`` (pcity, st, ...) with the area of their city: an override, or the first title that contains it.

    An override of None leaves the entry out. ``overrides`` is a small parameter table.
    """
    known = entries.sparkSession.createDataFrame(list(overrides.items()) or [("", None)], "pcity string, area_code string")
    known = F.broadcast(known)
    given = entries.join(known.where("area_code is not null"), "pcity")
    rest = entries.join(known.select("pcity"), "pcity", "left_anti")
    hit = contains_first(rest.select("pcity", "st").distinct(), titles, pattern="pcity", title="title_lc", title_key="area_code",
                         title_order="ord", extra=extra)
    return given.unionByName(rest.join(hit, ["pcity", "st"]))


@query("match_contains", with_fx(f"""
select area_code, {r6('sum(visitors)')} as visitors, count(*) as n_entries from (
  select e.place_id, e.visitors, o.area_code, 1 as rn
  from (select * from parsed order by visitors desc, place_id limit {TOP_VISITOR_ENTRIES}) e
  join (values {", ".join(f"('{k}', {'null' if v is None else _sql_str(v)})" for k, v in AREA_OVERRIDES.items())}) o(city, area_code)
    on o.city = lower(e.primary_city) where o.area_code is not null
  union all
  select e.place_id, e.visitors, t.area_code,
    row_number() over (partition by e.place_id order by t.ord, t.area_code) as rn
  from (select * from parsed order by visitors desc, place_id limit {TOP_VISITOR_ENTRIES}) e
  join titles t on lower(e.primary_city) not in ({", ".join(_sql_str(k) for k in AREA_OVERRIDES)}) and length(e.primary_city) > 0 and instr(lower(t.area_title), lower(e.primary_city)) > 0
    and (e.state = '' or instr(t.area_title, e.state) > 0)) x
where rn = 1 group by area_code
""", _CONTAINS_CTES))
def match_contains(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    e = visitor_entries(fx)
    top = e.orderBy(F.col("visitors").desc(), F.col("place_id")).limit(TOP_VISITOR_ENTRIES)
    pats = top.select("place_id", "visitors", F.lower(T.primary_city("msa_name")).alias("pcity"),
                      T.first_state("msa_name").alias("st"))
    titles = area_titles(fx).withColumn("title_lc", F.lower("area_title"))
    extra = (F.col("st") == "") | (F.instr(F.col("area_title"), F.col("st")) > 0)
    j = match_titles(pats, titles, AREA_OVERRIDES, extra)
    return j.groupBy("area_code").agg(round6(F.sum("visitors")).alias("visitors"),
                                      F.count(F.lit(1)).alias("n_entries"))
