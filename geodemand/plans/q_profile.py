"""Profiling queries over base tables and derived inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand.functions.geo import haversine_sql, round6
from geodemand.operators import profile as PR
from geodemand.plans.fixture_sql import r6, with_fx
from geodemand.plans.fixtures import Fixtures
from geodemand.plans.q_spatial import _NEAREST_SQL, match_in_block, nearest_any_block
from geodemand.plans.registry import query

TEXT_COLS = ["name", "town"]
NUMBER_COLS = ["place_id", "state", "pop", "lat", "lon"]
GAP_COLS = ["state", "lat", "lon", "raw_name", "value"]
CORR_FEATURES = ["nation", "balance", "n_orders", "avg_price", "n_finished", "pop", "lat", "lon"]


def _profile_sql(c):
    if c in TEXT_COLS:
        best = f"(select {{}} from fx_places where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
        return (f"select '{c}' as column_name, count({c}) as count, count(distinct {c}) as unique, {best.format(c)} as top, "
                f"{best.format('count(*)')} as freq, "
                + ", ".join(f"cast(null as double) as {m}" for m in ("mean", "std", "min", "p25", "p50", "p75", "max")) + " from fx_places")
    return (f"select '{c}' as column_name, count({c}) as count, count(distinct {c}) as unique, cast(null as varchar) as top, "
            f"cast(null as bigint) as freq, {r6(f'avg({c})')} as mean, "
            f"{r6(f'stddev_samp({c})')} as std, cast(min({c}) as double) as min, "
            f"{r6(f'quantile_cont({c}, 0.25)')} as p25, {r6(f'quantile_cont({c}, 0.5)')} as p50, "
            f"{r6(f'quantile_cont({c}, 0.75)')} as p75, cast(max({c}) as double) as max from fx_places")


@query("column_profile", with_fx("\nunion all\n".join(_profile_sql(c) for c in TEXT_COLS + NUMBER_COLS)))
def column_profile(spark, sf_dir):
    p = PR.column_profile(Fixtures(spark, sf_dir).places(), TEXT_COLS + NUMBER_COLS)
    return p.select("column_name", "count", "unique", "top", "freq", *[round6(c).alias(c) for c in ("mean", "std")], "min",
                    *[round6(c).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("missing_rates", with_fx("\nunion all\n".join(
    f"select '{c}' as column_name, {r6(f'avg(case when {c} is null then 1.0e0 else 0.0e0 end)')} as missing_rate,"
    f" (select cast(sum(case when state is not null and lat is not null and lon is not null then 1 else 0 end) as bigint)"
    f" from fx_obs_gaps) as n_complete from fx_obs_gaps" for c in GAP_COLS)))
def missing_rates(spark, sf_dir):
    g = Fixtures(spark, sf_dir).obs_gaps()
    m = PR.missing_rates(g, GAP_COLS)
    n_complete = PR.complete_rows(g, ["state", "lat", "lon"]).first()["n_complete"]
    return m.select("column_name", round6("missing_rate").alias("missing_rate"),
                    F.lit(n_complete).cast("bigint").alias("n_complete"))


@query("target_correlation", with_fx("\nunion all\n".join(
    f"select '{f}' as feature, {r6(f'corr({f}, y)')} as corr from fx_model" for f in CORR_FEATURES)))
def target_correlation(spark, sf_dir):
    m = Fixtures(spark, sf_dir).model_table()
    return PR.target_correlation(m, CORR_FEATURES, "y").select("feature", round6("corr").alias("corr"))


def _hist_sql(scale, expr, bins):
    return f"""select '{scale}' as scale, cast(i.bin as int) as bin, {r6('lo + i.bin * w')} as lo_edge, coalesce(c.n, 0) as n
from (select unnest(range(0, {bins})) as bin) i
cross join (select min({expr}) as lo, (max({expr}) - min({expr})) / {bins}.0e0 as w from fx_model) b
left join (select cast(least(floor((x - lo) / w), {bins - 1}) as bigint) as bin, count(*) as n
  from (select {expr} as x from fx_model) v,
       (select min({expr}) as lo, (max({expr}) - min({expr})) / {bins}.0e0 as w from fx_model) b
  where x is not null group by 1) c on c.bin = i.bin"""


@query("histogram", with_fx(_hist_sql("raw", "spend", 60) + "\nunion all\n" + _hist_sql("log", "ln(1.0e0 + spend)", 40)))
def histogram(spark, sf_dir):
    m = Fixtures(spark, sf_dir).model_table().withColumn("lspend", F.log(F.lit(1.0) + F.col("spend")))
    raw = PR.histogram(m, "spend", 60).withColumn("scale", F.lit("raw"))
    lg = PR.histogram(m, "lspend", 40).withColumn("scale", F.lit("log"))
    return raw.unionByName(lg).select("scale", "bin", round6("lo_edge").alias("lo_edge"), "n")


@query("duplicate_keys", with_fx("""
select l_orderkey, l_linenumber, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1
"""))
def duplicate_keys(spark, sf_dir):
    li = Fixtures(spark, sf_dir).t("lineitem")
    return PR.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


_H = haversine_sql("o.lat", "o.lon", "s.lat", "s.lon")


@query("coverage", with_fx(f"""
select (select count(*) from fx_obs) as n_total, count(*) as n_joined, {r6('median(d)')} as median_km,
  {r6('max(d)')} as max_km, cast(sum(case when value > 0 then 1 else 0 end) as bigint) as n_positive
from (select obs_id, value, d from (
  select o.obs_id, o2.value, {_H} as d,
    row_number() over (partition by o.obs_id order by {_H}, s.site_id) as rn
  from sus o join fx_sites s on s.state = o.state and {_H} <= 30.0e0 join fx_obs o2 on o2.obs_id = o.obs_id
  where not o.coord_suspect) x where rn = 1) y
""", _NEAREST_SQL.replace("OBS", "fx_obs")))
def coverage(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    obs = fx.obs()
    m = match_in_block(nearest_any_block(obs, fx.sites()), fx.sites()).join(obs.select("obs_id", "value"), "obs_id")
    n_total = obs.count()
    from geodemand.operators.quantiles import exact_quantiles
    med = exact_quantiles(m, "dist_km", [0.5])[0]
    return m.agg(F.lit(n_total).cast("bigint").alias("n_total"), F.count(F.lit(1)).alias("n_joined"),
                 round6(F.lit(med).cast("double")).alias("median_km"), round6(F.max("dist_km")).alias("max_km"),
                 F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).cast("bigint").alias("n_positive"))
