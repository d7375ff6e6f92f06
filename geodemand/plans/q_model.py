"""Modelling queries: feature preparation, strata, group folds, additive fits, OOF predictions, scoring, what-if."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geodemand.functions.geo import round6, round_to_sql
from geodemand.operators import additive as AD
from geodemand.operators.kmeans import fit_centres, with_group
from geodemand.operators.report import round_to
from geodemand.plans.fixture_sql import r6, with_fx
from geodemand.plans.fixtures import Fixtures
from geodemand.plans.q_spatial import _CAND_SQL, candidate_places  # noqa: F401
from geodemand.plans.registry import query
from geodemand.session import scratch_path
from geodemand.training import Training, fold_metrics, grouped_folds, train, train_final

FEATURES = ["nation", "balance", "segment", "n_orders", "avg_price", "n_finished", "pop", "lat", "lon"]
CATEGORICAL = ["segment"]
NUMERIC = [f for f in FEATURES if f not in CATEGORICAL]
ZERO_FILLED = ["n_orders", "n_finished"]      # "no activity yet" for candidates is 0, not missing
CURVE_FEATURE = "n_orders"
N_GROUPS, N_FOLDS, N_STRATA, SEED, RESTARTS = 20, 5, 5, 42, 10
ORACLE_ROUNDS, ORACLE_LR, ORACLE_BINS = 2, 0.01, 16
LOOKUP_NAME_RANK = 1


def model_rows(spark, sf_dir):
    return Fixtures(spark, sf_dir).model_table()


# ---- feature preparation --------------------------------------------------------------------

def prepare_features(df, flags=(), mode_fill=(), expected=(), types=None):
    """Schema-tolerant feature frame: absent columns typed NULL, flags NULL -> 0, categories NULL -> mode."""
    types = types or {}
    d = df
    for c in expected:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast(types.get(c, "double")))
    fills = {c: F.coalesce(F.col(c), F.lit(0)) for c in flags}
    for c in mode_fill:
        cnt = d.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        top = cnt.agg(F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c))).alias("_m")).first()["_m"]
        fills[c] = F.coalesce(F.col(c), F.lit(top))
    return d.withColumns(fills) if fills else d


@query("feature_fill", with_fx("""
select id, coalesce(seg, (select seg from (select nullif(segment, 'HOUSEHOLD') as seg from fx_model) s
   where seg is not null group by seg order by count(*) desc, seg limit 1)) as segment,
  coalesce(n_fin, 0.0e0) as n_finished, balance, cast(null as double) as weekly_departures
from (select id, nullif(segment, 'HOUSEHOLD') as seg,
  case when n_orders > 20 then null else n_finished end as n_fin, balance from fx_model) x
"""))
def feature_fill(spark, sf_dir):
    m = model_rows(spark, sf_dir).select(
        "id", F.nullif(F.col("segment"), F.lit("HOUSEHOLD")).alias("segment"),
        F.when(F.col("n_orders") > 20, F.lit(None)).otherwise(F.col("n_finished")).alias("n_finished"), "balance")
    p = prepare_features(m, flags=["n_finished"], mode_fill=["segment"], expected=["weekly_departures"])
    return p.select("id", "segment", F.col("n_finished").cast("double").alias("n_finished"), "balance",
                    "weekly_departures")


@query("quantile_bins", with_fx("""
select id, cast(len(list_filter(e[2:len(e) - 1], lambda v: y > v)) as int) as stratum
from fx_model, (select list_sort(list_distinct(quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) as e from fx_model) q
"""))
def quantile_bins(spark, sf_dir):
    s, _ = AD.quantile_strata(model_rows(spark, sf_dir), "y", N_STRATA, exact=True)
    return s.select("id", F.col("stratum").cast("int").alias("stratum"))


def _uniform_bin_sql(f, bins):
    return (f"case when {f} is null then 0 else 1 + cast(len(list_filter(list_transform(range(1, {bins}), "
            f"lambda i: lo_{f} + (hi_{f} - lo_{f}) * i / {bins}), lambda e: e < {f})) as int) end")


_RANGES_SQL = "select " + ", ".join(f"min({f}) as lo_{f}, max({f}) as hi_{f}" for f in NUMERIC) + " from fx_model"
_BINS_SQL = ("select id, y, " + ", ".join(f"{_uniform_bin_sql(f, ORACLE_BINS)} as b_{f}" for f in NUMERIC)
             + ", cast(dense_rank() over (order by segment) as int) as b_segment from fx_model, (" + _RANGES_SQL
             + ") r")


def _uniform_binning(spark, sf_dir):
    m = model_rows(spark, sf_dir)
    return m, AD.fit_binning(m, FEATURES, CATEGORICAL, max_bins=ORACLE_BINS, method="uniform")


@query("feature_bins", with_fx("select id, " + ", ".join(f"b_{f}" for f in FEATURES) + " from (" + _BINS_SQL
                               + ") b"))
def feature_bins(spark, sf_dir):
    m, bins = _uniform_binning(spark, sf_dir)
    return AD.binned(m, bins, keep=["id"]).select("id", *[F.col(f"b_{f}").cast("int").alias(f"b_{f}")
                                                          for f in FEATURES])


def _fit_rounds_sql():
    unp = "\nunion all\n".join(f"select id, y, '{f}' as feature, b_{f} as bin from bins" for f in FEATURES)
    return f"""
bins AS ({_BINS_SQL}),
unp AS ({unp}),
i0 AS (select avg(y) as i0 from fx_model),
raw1 AS (select feature, bin, sum(y - i0) as r, count(*) as n from unp, i0 group by feature, bin),
s1 AS (select feature, bin, n, case when n >= 2 then {ORACLE_LR}e0 * r / n else 0.0e0 end as s from raw1),
m1 AS (select feature, sum(s * n) / sum(n) as m from s1 group by feature),
sh1 AS (select s1.feature, s1.bin, s1.n, s1.s - m1.m as s from s1 join m1 on m1.feature = s1.feature),
i1 AS (select (select i0 from i0) + (select sum(m) from m1) as i1),
p1 AS (select u.id, min(u.y) as y, (select i1 from i1) + sum(sh.s) as p from unp u
       join sh1 sh on sh.feature = u.feature and sh.bin = u.bin group by u.id),
raw2 AS (select u.feature, u.bin, sum(p1.y - p1.p) as r, count(*) as n from unp u join p1 on p1.id = u.id
         group by u.feature, u.bin),
s2 AS (select sh.feature, sh.bin, sh.n, sh.s + case when r.n >= 2 then {ORACLE_LR}e0 * r.r / r.n else 0.0e0 end as s
       from sh1 sh join raw2 r on r.feature = sh.feature and r.bin = sh.bin),
m2 AS (select feature, sum(s * n) / sum(n) as m from s2 group by feature)"""


def _two_round_sql():
    """The two-round fit completed: score of every bin (``shape``) and the intercept (``ic``)."""
    numeric = " union all ".join(f"select '{f}' as feature, unnest(range(0, {ORACLE_BINS + 1})) as bin" for f in NUMERIC)
    return _fit_rounds_sql() + f""",
rng AS ({_RANGES_SQL}),
seg AS (select segment, cast(dense_rank() over (order by segment) as int) as b from (select distinct segment from fx_model) d),
cells AS ({numeric} union all select 'segment' as feature, unnest(range(0, (select count(*) + 2 from seg))) as bin),
shape AS (select c.feature, cast(c.bin as int) as bin, coalesce(s2.s, -m1.m) - m2.m as score
  from cells c left join s2 on s2.feature = c.feature and s2.bin = c.bin join m1 on m1.feature = c.feature
  join m2 on m2.feature = c.feature),
ic AS (select (select i1 from i1) + (select sum(m) from m2) as c)"""


def _scores_sql(rel, key, present):
    """(key, p) of the rows of ``rel``; features that are not ``present`` are missing in it."""
    bins = [f"{_uniform_bin_sql(f, ORACLE_BINS)} as b_{f}" if f in present else f"0 as b_{f}" for f in NUMERIC]
    bins.append("coalesce(seg.b, 0) as b_segment")
    unp = " union all ".join(f"select {key}, '{f}' as feature, b_{f} as bin from b" for f in FEATURES)
    return f"""(with b as (select v.{key}, {", ".join(bins)} from {rel} v cross join rng left join seg on seg.segment = v.segment)
  select u.{key}, min(ic.c) + sum(sh.score) as p from ({unp}) u join shape sh on sh.feature = u.feature and sh.bin = u.bin, ic
  group by u.{key})"""


def two_round_model(spark, sf_dir):
    """(rows, fitted model) of the fit that the oracle restates: two rounds on equal-width bins."""
    m, bins = _uniform_binning(spark, sf_dir)
    comp = AD.compress(AD.binned(m, bins, keep=["y"]), FEATURES).checkpoint()
    return m, AD.fit_additive(comp, FEATURES, bins, rounds=ORACLE_ROUNDS, learning_rate=ORACLE_LR, min_leaf=2)


@query("additive_fit_rounds", with_fx(f"""
select s2.feature, cast(s2.bin as int) as bin, {r6('s2.s - m2.m')} as score from s2 join m2 on m2.feature = s2.feature
union all
select '(intercept)' as feature, 0 as bin, {r6('(select i1 from i1) + (select sum(m) from m2)')} as score
""", _fit_rounds_sql()))
def additive_fit_rounds(spark, sf_dir):
    """Two boosting rounds on equal-width bins (each round one aggregation job); shape scores of observed bins."""
    m, bins = _uniform_binning(spark, sf_dir)
    b = AD.binned(m, bins, keep=["y"])
    comp = AD.compress(b, FEATURES).checkpoint()
    model = AD.fit_additive(comp, FEATURES, bins, rounds=ORACLE_ROUNDS, learning_rate=ORACLE_LR, min_leaf=2)
    shapes = model.shape_table(spark).select("feature", "bin", "score")
    observed = b.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"b_{f}").cast("int")
                                                      .alias("bin")) for f in FEATURES])).alias("k")).select(
        "k.*").distinct()
    s = shapes.join(observed, ["feature", "bin"]).select("feature", "bin", round6("score").alias("score"))
    icpt = spark.range(1).select(F.lit("(intercept)").alias("feature"), F.lit(0).alias("bin"),
                                 round6(F.lit(float(model.intercept))).alias("score"))
    return s.unionByName(icpt)


# ---- the full fit: 256 quantile bins, rate 0.01, three pairs, as many rounds as the validation loss asks for --------

def trained(spark, sf_dir, folder=None) -> Training:
    return train(model_rows(spark, sf_dir), FEATURES, CATEGORICAL, groups=N_GROUPS, folds=N_FOLDS, strata=N_STRATA, restarts=RESTARTS, seed=SEED,
                 folder=folder)


def final_model(spark, sf_dir):
    """(rows, the model on all of them)."""
    m = model_rows(spark, sf_dir)
    return m, train_final(m, FEATURES, CATEGORICAL, seed=SEED)


def _groups(spark, sf_dir):
    m = model_rows(spark, sf_dir)
    return with_group(m, fit_centres(m, N_GROUPS, SEED, RESTARTS))


@query("geo_groups")
def geo_groups(spark, sf_dir):
    return _groups(spark, sf_dir).select("id", "grp")


@query("cluster_sizes")
def cluster_sizes(spark, sf_dir):
    sizes = _groups(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min_size"), F.median("n").alias("median_size"), F.max("n").alias("max_size"),
                     F.count(F.lit(1)).alias("n_groups"))


@query("group_folds")
def group_folds(spark, sf_dir):
    m = model_rows(spark, sf_dir)
    return grouped_folds(m, groups=N_GROUPS, folds=N_FOLDS, strata=N_STRATA, restarts=RESTARTS, seed=SEED).select("id", "grp", "fold")


@query("oof_predictions")
def oof_predictions(spark, sf_dir):
    """Each row predicted once, by the model of the fold that did not see it; original integer actual kept."""
    return report_predictions(trained(spark, sf_dir).out_of_fold())


@query("job_train")
def job_train(spark, sf_dir):
    """The training job with its folder: out-of-fold predictions as written, beside the scores of the model as read back."""
    import uuid
    folder = scratch_path(spark, f"train-{uuid.uuid4().hex}")
    trained(spark, sf_dir, folder)
    model = AD.load_model(spark, f"{folder}/model")
    oof = spark.read.parquet(f"{folder}/oof").withColumnRenamed("pred_log", "oof_log")
    return model.score(oof).select("id", "fold", round6("y").alias("y"), round6("oof_log").alias("oof_log"), round6("pred_log").alias("pred_log"))


def report_predictions(o):
    """Original integer actual, prediction back on its scale, logs and percent error."""
    actual = F.floor("spend").cast("bigint")
    pred = F.expm1("pred_log")
    return o.select("id", "name", "fold", actual.alias("actual"), F.floor(pred).cast("bigint").alias("predicted"),
                    round6("y").alias("y"), round6("pred_log").alias("pred_log"),
                    round_to((pred - F.col("spend")) / F.col("spend") * 100.0, 1).alias("pct_error"))


def given_predictions(spark, sf_dir):
    """Rows with a given fold and prediction, for the reports on any model's out-of-fold predictions."""
    return model_rows(spark, sf_dir).withColumns({
        "fold": (F.col("nation") % N_FOLDS).cast("int"),
        "pred_log": F.col("y") * 0.95 + 0.3 + (F.col("id") % 13 - 6) * 0.02})


_GIVEN_SQL = f"""
oof AS (select *, cast(nation % {N_FOLDS} as int) as fold, y * 0.95e0 + 0.3e0 + (id % 13 - 6) * 0.02e0 as pred_log from fx_model),
per AS (select fold, sqrt(avg((y - pred_log) * (y - pred_log))) as rmse_log,
  1 - sum((y - pred_log) * (y - pred_log)) / (var_pop(y) * count(*)) as r2, count(*) as n from oof group by fold),
overall AS (select sqrt(avg((y - pred_log) * (y - pred_log))) as rmse_log,
  1 - sum((y - pred_log) * (y - pred_log)) / (var_pop(y) * count(*)) as r2, count(*) as n from oof)"""


def _metrics_union(oof):
    return fold_metrics(oof).select("label", "fold", round6("rmse_log").alias("rmse_log"), round6("r2").alias("r2"), "n")


@query("metrics_union")
def metrics_union(spark, sf_dir):
    """Error of the full fit, by fold and over all out-of-fold predictions."""
    return _metrics_union(trained(spark, sf_dir).out_of_fold())


@query("given_metrics_union", with_fx(f"""
select 'fold_' || cast(fold + 1 as varchar) as label, fold, {r6('rmse_log')} as rmse_log, {r6('r2')} as r2, n from per
union all select 'oof_overall', null, {r6('rmse_log')}, {r6('r2')}, n from overall
""", _GIVEN_SQL))
def given_metrics_union(spark, sf_dir):
    """Twin of ``metrics_union`` on given predictions, which SQL can restate."""
    return _metrics_union(given_predictions(spark, sf_dir))


def _regression_metrics(oof):
    m = fold_metrics(oof).checkpoint()
    summ = m.where("fold is not null").agg(F.avg("rmse_log").alias("rmse_mean"), F.stddev_samp("rmse_log").alias("rmse_std"),
                                           F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_std"))
    # Four scalars from a five-row table, attached as literals.
    return m.where("fold is null").select(round6("rmse_log").alias("rmse_log"), round6("r2").alias("r2"), "n",
                                          *[round6(F.lit(v)).alias(k) for k, v in summ.first().asDict().items()])


@query("regression_metrics")
def regression_metrics(spark, sf_dir):
    return _regression_metrics(trained(spark, sf_dir).out_of_fold())


@query("given_regression_metrics", with_fx(f"""
select {r6('o.rmse_log')} as rmse_log, {r6('o.r2')} as r2, o.n, {r6('p.rmse_mean')} as rmse_mean, {r6('p.rmse_std')} as rmse_std,
  {r6('p.r2_mean')} as r2_mean, {r6('p.r2_std')} as r2_std
from overall o, (select avg(rmse_log) as rmse_mean, stddev_samp(rmse_log) as rmse_std, avg(r2) as r2_mean,
  stddev_samp(r2) as r2_std from per) p
""", _GIVEN_SQL))
def given_regression_metrics(spark, sf_dir):
    return _regression_metrics(given_predictions(spark, sf_dir))


@query("pair_gain")
def pair_gain(spark, sf_dir):
    """The three best pairs by the four-way cut of the main effects' residuals."""
    gains = trained(spark, sf_dir).fit.gains["final"]
    rows = [(a, b, float(g), i + 1) for i, ((a, b), g) in enumerate(gains[:3])]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, gain double, rank int")


def _shape_importance(m, model, spark, sf_dir):
    rows = spark.createDataFrame(AD.importance(model), "feature string, mean_abs_score double, score_range double, n_bins int")
    return rows.select("feature", round6("mean_abs_score").alias("mean_abs_score"), round6("score_range").alias("score_range"), "n_bins")


@query("shape_importance")
def shape_importance(spark, sf_dir):
    """Importance of the features in the full fit."""
    return _shape_importance(*final_model(spark, sf_dir), spark, sf_dir)


@query("two_round_importance", with_fx(f"""
select feature, {r6('avg(abs(score))')} as mean_abs_score, {r6('max(score) - min(score)')} as score_range,
  cast(count(*) as int) as n_bins from shape group by feature
""", _two_round_sql()))
def two_round_importance(spark, sf_dir):
    return _shape_importance(*two_round_model(spark, sf_dir), spark, sf_dir)


def _additive_score(m, model, spark, sf_dir):
    return model.score(m).select("id", round6("pred_log").alias("pred_log"))


@query("additive_score")
def additive_score(spark, sf_dir):
    """Predictions of the full fit."""
    return _additive_score(*final_model(spark, sf_dir), spark, sf_dir)


@query("two_round_score", with_fx(f"""
select id, {r6('p')} as pred_log from {_scores_sql('fx_model', 'id', NUMERIC)} x
""", _two_round_sql()))
def two_round_score(spark, sf_dir):
    return _additive_score(*two_round_model(spark, sf_dir), spark, sf_dir)


def _candidates_features(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    c = candidate_places(fx).select("code", "place_id")
    m = model_rows(spark, sf_dir).drop(*ZERO_FILLED, "avg_price")
    j = c.join(m, m["id"] == c["place_id"], "left").drop("id")
    return prepare_features(j, flags=ZERO_FILLED, expected=ZERO_FILLED + ["avg_price"])


_CANDIDATE_ROWS_SQL = f"""(select c.code, m.nation, m.balance, m.segment, 0.0e0 as n_orders, 0.0e0 as n_finished, m.pop, m.lat, m.lon
  from cand c left join fx_model m on m.id = c.place_id)"""


def _candidate_scores(m, model, spark, sf_dir):
    s = model.score(_candidates_features(spark, sf_dir)).withColumn("predicted_log", round6("pred_log"))
    w = Window.orderBy(F.col("predicted_log").desc(), F.col("code"))
    ranked = s.withColumn("rank", F.row_number().over(w))
    return ranked.select("rank", "code", "predicted_log",
                         F.round(F.expm1("pred_log")).cast("bigint").alias("predicted"))


@query("candidate_scores")
def candidate_scores(spark, sf_dir):
    """Candidates scored with zero activity features; ranked by predicted value."""
    return _candidate_scores(*final_model(spark, sf_dir), spark, sf_dir)


@query("two_round_candidates", with_fx(f"""
select cast(row_number() over (order by {r6('p')} desc, code) as int) as rank, code, {r6('p')} as predicted_log,
  cast(round(exp(p) - 1.0e0) as bigint) as predicted
from {_scores_sql(_CANDIDATE_ROWS_SQL, 'code', [f for f in NUMERIC if f != 'avg_price'])} x
""", _two_round_sql() + "," + _CAND_SQL))
def two_round_candidates(spark, sf_dir):
    return _candidate_scores(*two_round_model(spark, sf_dir), spark, sf_dir)


def curve_points(model, feature):
    """(x, score) points of a numeric shape: bin left edges with the score of the bin they open."""
    rows = [r for r in model.shape_rows() if r[0] == feature and r[1] >= 2 and r[2] is not None]
    xs = [float(r[2]) for r in rows]
    ys = [float(r[5]) for r in rows]
    return xs, ys


def interpolate(x, xs, ys):
    """Piecewise-linear through (xs, ys), clamped outside; a column expression over literal arrays."""
    if not xs:
        return F.lit(0.0)
    X = F.array(*[F.lit(v) for v in xs])
    Y = F.array(*[F.lit(v) for v in ys])
    n = len(xs)
    lo = F.size(F.filter(X, lambda b: b <= x))          # 1-based index of the last edge <= x
    xl, xh = F.element_at(X, lo), F.element_at(X, lo + 1)
    yl, yh = F.element_at(Y, lo), F.element_at(Y, lo + 1)
    inner = yl + (x - xl) / (xh - xl) * (yh - yl)
    return (F.when(x <= F.lit(xs[0]), F.lit(ys[0])).when(x >= F.lit(xs[-1]), F.lit(ys[-1]))
            .otherwise(inner) if n > 1 else F.lit(ys[0]))


def _curve_sql():
    return _two_round_sql() + f""",
crv AS (select list(x order by bin) as xs, list(score order by bin) as ys from (select bin, score,
  lo_{CURVE_FEATURE} + (hi_{CURVE_FEATURE} - lo_{CURVE_FEATURE}) * (bin - 1) / {ORACLE_BINS} as x
  from shape, rng where feature = '{CURVE_FEATURE}' and bin >= 2) c)"""


def _interpolate_sql(x):
    k = f"len(list_filter(xs, lambda e: e <= {x}))"
    return (f"(case when {x} <= xs[1] then ys[1] when {x} >= xs[len(xs)] then ys[len(ys)] "
            f"else ys[{k}] + ({x} - xs[{k}]) / (xs[{k} + 1] - xs[{k}]) * (ys[{k} + 1] - ys[{k}]) end)")


def _curve_interpolate(m, model, spark, sf_dir):
    xs, ys = curve_points(model, CURVE_FEATURE)
    return m.select("id", F.col(CURVE_FEATURE).alias("x"),
                    round6(interpolate(F.col(CURVE_FEATURE).cast("double"), xs, ys)).alias("curve_score"))


@query("curve_interpolate")
def curve_interpolate(spark, sf_dir):
    """The full fit's curve of one feature, between its bins' edges."""
    return _curve_interpolate(*final_model(spark, sf_dir), spark, sf_dir)


@query("two_round_curve", with_fx(f"""
select id, {CURVE_FEATURE} as x, {r6(_interpolate_sql(CURVE_FEATURE))} as curve_score from fx_model, crv
""", _curve_sql()))
def two_round_curve(spark, sf_dir):
    return _curve_interpolate(*two_round_model(spark, sf_dir), spark, sf_dir)


def _what_if_grid(m, model, spark, sf_dir):
    xs, ys = curve_points(model, CURVE_FEATURE)
    m = m.where(F.col(CURVE_FEATURE).isNotNull())
    cur = F.col(CURVE_FEATURE).cast("double")
    top = F.ceil(F.greatest(cur, F.lit(500.0)) / 7) * 7
    g = m.select("id", "spend", cur.alias("current"), F.explode(F.sequence(F.lit(7), top.cast("int"), F.lit(7)))
                 .alias("trips"))
    delta = interpolate(F.col("trips").cast("double"), xs, ys) - interpolate(F.col("current"), xs, ys)
    est = F.round(F.expm1(F.log1p("spend") + delta)).cast("bigint")
    return g.select("id", "trips", est.alias("estimate"))


@query("what_if_grid")
def what_if_grid(spark, sf_dir):
    """Per entity: estimate on a grid of the curve feature (7 .. ceil(max(500, current)/7)*7 by 7)."""
    return _what_if_grid(*final_model(spark, sf_dir), spark, sf_dir)


@query("two_round_what_if", with_fx(f"""
select id, cast(trips as int) as trips, cast(round(exp(ln(1.0e0 + spend) + {_interpolate_sql('cast(trips as double)')}
  - {_interpolate_sql(CURVE_FEATURE)}) - 1.0e0) as bigint) as estimate
from (select *, unnest(range(7, cast(ceil(greatest({CURVE_FEATURE}, 500.0e0) / 7) * 7 as bigint) + 1, 7)) as trips
  from fx_model where {CURVE_FEATURE} is not null) g, crv
""", _curve_sql()))
def two_round_what_if(spark, sf_dir):
    return _what_if_grid(*two_round_model(spark, sf_dir), spark, sf_dir)


_SCENARIO_SQL = "(select segment, avg(n_orders) as n_orders, avg(pop) as pop from fx_model group by segment)"


def _scenario_scores(m, model, spark, sf_dir):
    sc = m.groupBy("segment").agg(F.avg("n_orders").alias("n_orders"), F.avg("pop").alias("pop"))
    s = model.score(sc)
    return s.select("segment", round6("n_orders").alias("n_orders"), round6("pop").alias("pop"), round6("pred_log").alias("pred_log"),
                    F.round(F.expm1("pred_log")).cast("bigint").alias("predicted"))


@query("scenario_scores")
def scenario_scores(spark, sf_dir):
    """Hypothetical rows per segment: typical activity values, every other feature missing."""
    return _scenario_scores(*final_model(spark, sf_dir), spark, sf_dir)


@query("two_round_scenarios", with_fx(f"""
select s.segment, {r6('s.n_orders')} as n_orders, {r6('s.pop')} as pop, {r6('x.p')} as pred_log,
  cast(round(exp(x.p) - 1.0e0) as bigint) as predicted
from {_scores_sql(_SCENARIO_SQL, 'segment', ['n_orders', 'pop'])} x join {_SCENARIO_SQL} s on s.segment = x.segment
""", _two_round_sql()))
def two_round_scenarios(spark, sf_dir):
    return _scenario_scores(*two_round_model(spark, sf_dir), spark, sf_dir)


def _entity_lookup(spark, sf_dir, oof):
    name = model_rows(spark, sf_dir).orderBy(F.col("spend").desc(), "id").select("name").limit(LOOKUP_NAME_RANK)
    return report_predictions(oof).join(name, "name").select("id", "name", "actual", "predicted", "pct_error")


@query("entity_lookup")
def entity_lookup(spark, sf_dir):
    """One entity by name (the largest spender's name): actual, out-of-fold prediction, percent error."""
    return _entity_lookup(spark, sf_dir, trained(spark, sf_dir).out_of_fold())


@query("given_entity_lookup", with_fx(f"""
select id, name, cast(floor(spend) as bigint) as actual, cast(floor(exp(pred_log) - 1.0e0) as bigint) as predicted,
  {round_to_sql('(exp(pred_log) - 1.0e0 - spend) / spend * 100.0e0', 1)} as pct_error
from oof where name = (select name from fx_model order by spend desc, id limit 1)
""", _GIVEN_SQL))
def given_entity_lookup(spark, sf_dir):
    return _entity_lookup(spark, sf_dir, given_predictions(spark, sf_dir))
