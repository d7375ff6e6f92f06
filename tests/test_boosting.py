"""Boosted trees from moments against rows and brute force; a broken-off fit goes on to the same model; k-means restarts."""


import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geodemand.operators import additive as AD
from geodemand.operators import boosting as B
from geodemand.operators.kmeans import fit_centres, with_group
from geodemand.training import fold_metrics, train


def error(r, n, parts):
    return sum(-(r[a:b].sum() ** 2) / n[a:b].sum() for a, b in parts if n[a:b].sum() > 0)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6))
def test_first_split_lowers_the_error_most(size, seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 4, size).astype(float)
    r = np.where(n > 0, rng.normal(size=size), 0.0)
    parts = B.best_leaves(r, n, 2, 2)
    fits = [[(0, i), (i, size)] for i in range(1, size) if n[:i].sum() >= 2 and n[i:].sum() >= 2]
    best = min((error(r, n, f) for f in fits), default=None)
    whole = error(r, n, [(0, size)])
    if best is None or best >= whole - 1e-12:
        assert parts == [(0, size)]
    else:
        assert error(r, n, parts) == pytest.approx(best)
    three = B.best_leaves(r, n, 3, 2)
    assert len(three) <= 3 and error(r, n, three) <= error(r, n, parts) + 1e-12
    assert all(n[a:b].sum() >= 2 for a, b in three) or len(three) == 1


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6))
def test_best_quadrants_equal_brute_force(a, b, seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 4, (a, b)).astype(float)
    r = np.where(n > 0, rng.normal(size=(a, b)), 0.0)
    best = 0.0
    for i in range(1, a):
        for j in range(1, b):
            quarters = [(x[s], y[s]) for x, y in [(r, n)] for s in (np.s_[:i, :j], np.s_[:i, j:], np.s_[i:, :j], np.s_[i:, j:])]
            if all(q.sum() == 0 or q.sum() >= 2 for _, q in quarters):
                best = max(best, sum(p.sum() ** 2 / q.sum() for p, q in quarters if q.sum()) - r.sum() ** 2 / max(n.sum(), 1))
    assert AD.best_quadrants(r, n, 2)[0] == pytest.approx(best, abs=1e-9)


def test_ranked_pairs_equal_row_sums(spark):
    rows = sample(spark, 600)
    bins = AD.fit_binning(rows, FEATURES, ["c"], 6)
    small = AD.binned(rows, bins, keep=["y"])
    model = AD.fit_additive(AD.compress(small, FEATURES).checkpoint(), FEATURES, bins, rounds=3, pair_coarse=5)
    pdf = small.toPandas()
    left = pdf.y - model.intercept - sum(model.shapes[f][pdf[f"b_{f}"]] for f in FEATURES)
    want = {}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        shape = model.n_coarse(a), model.n_coarse(b)
        n, r = np.zeros(shape), np.zeros(shape)
        at = tuple(AD._coarse(pdf[f"b_{f}"].to_numpy(), bins[f].n_bins, 5) for f in (a, b))
        np.add.at(n, at, 1)
        np.add.at(r, at, left)
        want[a, b] = AD.best_quadrants(r, n, 2)[0]
    got = dict(AD.pair_gains(AD.compress(small, FEATURES), model))
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def sample(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 10, n), np.where(rng.random(n) < 0.1, np.nan, rng.uniform(0, 1, n))
    c = rng.choice(["x", "y", "z"], n)
    y = np.sin(a) + np.nan_to_num(b, nan=2.0) + (c == "y") + 0.8 * (a > 5) * (np.nan_to_num(b, nan=0.0) > 0.5) + 0.05 * rng.normal(size=n)
    rows = [(i, float(a[i]), None if np.isnan(b[i]) else float(b[i]), None if i % 29 == 0 else str(c[i]), float(y[i]), float(a[i]), float(i % 7), i % 3,
             int(i % 7 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double, lat double, lon double, fold int, part int")


FEATURES, SMALL = ["a", "b", "c"], B.Boosting(max_bins=32, learning_rate=0.1, pair_bins=8, interactions=1, patience=10, save_every=7)


def test_moments_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "_CELLS", 2000)  # several passes
    rows = sample(spark)
    bins = AD.fit_binning(rows, FEATURES, ["c"], 16)
    small = AD.binned(rows, bins, keep=["fold", "part", "y"])
    sizes = [bins[f].n_bins for f in FEATURES]

    def cells_of(batch):
        fold, part, cells, y = B._slots_of(batch, FEATURES)
        yield 2 * fold + part, cells, y

    found = B.read_moments(B.count_moments(small.select(F.col("fold"), "part", "y", *[F.col(f"b_{f}").cast("int").alias(f"b_{f}") for f in FEATURES]),
                                           sizes, 6, cells_of), sizes, 6)
    pdf = small.toPandas()
    starts = B._starts(sizes)
    for slot, m in enumerate(found):
        own = pdf[(pdf.fold == slot // 2) & (pdf.part == slot % 2)]
        hot = np.zeros((len(own), starts[-1]))
        for f, s in zip(FEATURES, starts, strict=False):
            hot[np.arange(len(own)), s + own[f"b_{f}"].to_numpy()] = 1
        assert m.n == len(own) and np.isclose(m.y, own.y.sum()) and np.isclose(m.yy, (own.y ** 2).sum())
        assert (m.count == hot.sum(axis=0)).all() and np.allclose(m.total, hot.T @ own.y.to_numpy()) and (m.shared == hot.T @ hot).all()


def test_rounds_on_moments_equal_rounds_on_rows(spark):
    rows = sample(spark)
    how = SMALL._replace(interactions=0)
    fit = B.fit_boosted(rows.drop("fold"), FEATURES, ["c"], how)
    model = fit.models["final"]
    pdf = AD.binned(rows, model.bins, keep=["y", "part"]).toPandas()
    tr, va = pdf[pdf.part == 0], pdf[pdf.part == 1]
    score = {f: np.zeros(model.bins[f].n_bins) for f in FEATURES}
    base = tr.y.mean()
    left = lambda d: d.y.to_numpy() - base - sum(score[f][d[f"b_{f}"]] for f in FEATURES)
    best, best_score, mark, at, k = (left(va) ** 2).sum(), None, (left(va) ** 2).sum(), 0, 0
    while k - at < how.patience:
        for f in FEATURES:
            size = model.bins[f].n_bins
            n = np.bincount(tr[f"b_{f}"], minlength=size).astype(float)
            r = np.bincount(tr[f"b_{f}"], left(tr), size)
            groups = [[0]]
            places = np.arange(1, size)
            if f == "c":
                groups.append([size - 1])
                places = np.array(sorted((i for i in range(1, size - 1) if n[i]), key=lambda i: r[i] / n[i]))
            groups += [places[a:b].tolist() for a, b in B.best_leaves(r[places], n[places], 3, 2)]
            for g in groups:
                if n[g].sum() >= 2:
                    score[f][g] += 0.1 * r[g].sum() / n[g].sum()
        k += 1
        loss = (left(va) ** 2).sum()
        if loss < best:
            best, best_score, found = loss, {f: v.copy() for f, v in score.items()}, k
        if loss < mark * (1 - how.tolerance):
            mark, at = loss, k
    assert fit.rounds["final"][0] == found
    got = model.score(rows).toPandas().set_index("id").pred_log.sort_index().to_numpy()
    all_bins = AD.binned(rows, model.bins, keep=["id"]).toPandas().set_index("id").sort_index()
    want = base + sum(best_score[f][all_bins[f"b_{f}"]] for f in FEATURES)
    assert np.allclose(got, want, atol=1e-8)


def test_quality_pairs_and_folds(spark):
    rows = sample(spark)
    fit = B.fit_boosted(rows, FEATURES, ["c"], SMALL, folds=3)
    assert sorted(map(str, fit.models)) == ["0", "1", "2", "final"]
    assert fit.gains["final"][0][0] == ("a", "b") and fit.gains["final"][0][1] > 3 * fit.gains["final"][1][1]
    assert all(m >= 10 and p >= 1 for m, p in fit.rounds.values())
    oof = [fit.models[f].score(rows.where(F.col("fold") == f)) for f in range(3)]
    m = fold_metrics(oof[0].unionByName(oof[1]).unionByName(oof[2])).collect()
    assert len(m) == 4 and all(r.r2 > 0.95 for r in m) and sum(r.n for r in m if r.fold is not None) == 1500
    for f in range(3):  # the model of a fold has not seen it
        alone = B.fit_boosted(rows.where(F.col("fold") != f), FEATURES, ["c"], SMALL)
        assert alone.models["final"].intercept == pytest.approx(fit.models[f].intercept, abs=0.05)


def shapes_of(fit):
    return {k: (m.intercept, {f: s.tolist() for f, s in m.shapes.items()}, {p: s.tolist() for p, s in m.pairs.items()}) for k, m in fit.models.items()}


def test_a_broken_off_fit_goes_on_to_the_same_model(spark, tmp_path, monkeypatch):
    rows = sample(spark).checkpoint()
    whole = shapes_of(B.fit_boosted(rows, FEATURES, ["c"], SMALL, folds=3, folder=str(tmp_path / "whole")))
    keep, calls = B.Store.keep, []

    def dying(self, name, states):
        keep(self, name, states)
        calls.append(name)
        if len(calls) in (2, 5):
            raise KeyboardInterrupt("the driver is lost")

    monkeypatch.setattr(B.Store, "keep", dying)
    folder, scans = str(tmp_path / "broken"), []
    monkeypatch.setattr(B, "count_moments", lambda *a, f=B.count_moments: scans.append(1) or f(*a))
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            B.fit_boosted(rows, FEATURES, ["c"], SMALL, folds=3, folder=folder)
    again = shapes_of(B.fit_boosted(rows, FEATURES, ["c"], SMALL, folds=3, folder=folder))
    assert again.keys() == whole.keys()
    for k in whole:
        assert again[k] == whole[k]
    assert len(scans) == 1 + 4  # main effects once, pairs once a model
    before = len(calls)
    B.fit_boosted(rows, FEATURES, ["c"], SMALL, folds=3, folder=folder)
    assert len(calls) == before  # nothing is left to do


def test_a_half_written_table_is_made_anew(spark, tmp_path):
    store = B.Store(spark, str(tmp_path))

    def breaks():
        raise ValueError("broken")

    with pytest.raises(ValueError):
        store.table("t", breaks)
    assert store.table("t", lambda: spark.range(3)).count() == 3
    assert store.table("t", breaks).count() == 3


def test_rows_without_y_constant_and_missing_features(spark):
    rows = sample(spark, 200).withColumns({"y": F.when(F.col("id") % 9 == 0, None).otherwise(F.lit(2.5)), "a": F.lit(None).cast("double"),
                                           "c": F.lit("only")})
    fit = B.fit_boosted(rows, FEATURES, ["c"], SMALL, folds=3)
    assert all(m.intercept == pytest.approx(2.5) for m in fit.models.values())
    got = fit.models["final"].score(rows).select("pred_log").distinct().collect()
    assert all(r.pred_log == pytest.approx(2.5) for r in got)


def test_training_job_writes_its_outputs(spark, tmp_path):
    rows = sample(spark).drop("fold", "part")
    folder = str(tmp_path / "job")
    done = train(rows, FEATURES, ["c"], how=SMALL, groups=6, folds=3, restarts=2, folder=folder)
    oof = spark.read.parquet(f"{folder}/oof")
    assert oof.count() == 1500 and oof.select("id").distinct().count() == 1500
    assert oof.groupBy("grp").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    m = {r.label: r for r in spark.read.parquet(f"{folder}/metrics").collect()}
    assert sorted(m) == ["fold_1", "fold_2", "fold_3", "oof_overall"] and m["oof_overall"].n == 1500
    model = AD.load_model(spark, f"{folder}/model")
    a = model.score(rows).select("id", "pred_log").orderBy("id").toPandas()
    b = done.fit.models["final"].score(rows).select("id", "pred_log").orderBy("id").toPandas()
    assert np.allclose(a.pred_log, b.pred_log, atol=1e-12)
    assert spark.read.parquet(f"{folder}/shapes").count() == sum(b.n_bins for b in model.bins.values())
    assert spark.read.parquet(f"{folder}/importance").orderBy(F.desc("mean_abs_score")).first().feature in FEATURES


def test_restarts_reach_the_cost_of_ten_single_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (120, 2)) for c in rng.uniform(-20, 20, (8, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(9000, None, 1.0), (9001, None, None)], "id long, lat double, lon double")
    cost = lambda c: float(((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
    centres = fit_centres(df, 8, seed=5, restarts=10)
    vec = VectorAssembler(inputCols=["lat", "lon"], outputCol="features").transform(df.where("lat is not null")).cache()
    single = min(KMeans(k=8, seed=s).fit(vec).summary.trainingCost for s in range(10))
    assert cost(centres) <= single * 1.001
    got = {r.id: r.grp for r in with_group(df, centres).collect()}
    want = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [got[i] for i in range(len(x))] == want.tolist() and got[9000] == got[9001] == -1


def test_a_step_is_one_scan_for_all_restarts(spark, monkeypatch):
    from geodemand.operators import kmeans as K
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("lat"), (F.col("id") % 17).cast("double").alias("lon"))
    steps = []
    monkeypatch.setattr(K, "_sums", lambda c, f=K._sums: steps.append(len(c)) or f(c))
    fit_centres(df, 4, restarts=6)
    assert steps[0] == 6 and steps == sorted(steps, reverse=True)
    assert len(fit_centres(df.limit(0), 3)) == 0
    assert len(fit_centres(df.limit(1), 3)) == 3


