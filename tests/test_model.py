"""Additive model, strata and group folds: structural properties."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from geodemand.operators import additive as AD
from geodemand.plans import q_model as QM


def test_strata_equal_pandas_qcut(spark, sf_small):
    m = QM.model_rows(spark, sf_small).select("id", "y")
    s, _ = AD.quantile_strata(m, "y", 5, exact=True)
    pdf = s.toPandas().sort_values("id")
    exp = pd.qcut(pdf["y"], 5, labels=False, duplicates="drop")
    assert (pdf["stratum"].to_numpy() == exp.to_numpy()).all()


def test_group_fold_assignment_properties():
    counts = {g: {s: (g * 7 + s * 3) % 11 + 1 for s in range(5)} for g in range(-1, 20)}
    folds = AD.assign_group_folds(counts, 5)
    assert set(folds) == set(counts)
    assert set(folds.values()) == set(range(5))


def test_fit_loss_non_increasing_and_score_equals_lookup(spark, sf_small):
    m = QM.model_rows(spark, sf_small)
    bins = AD.fit_binning(m, QM.FEATURES, QM.CATEGORICAL, max_bins=16)
    comp = AD.compress(AD.binned(m, bins, keep=["y"]), QM.FEATURES).persist()
    model = AD.fit_additive(comp, QM.FEATURES, bins, rounds=8, learning_rate=0.1, interactions=2,
                            interaction_rounds=4)
    h = model.history
    assert all(b <= a + 1e-12 for a, b in zip(h, h[1:])), h
    scored = model.score(m).select("id", "pred_log")
    # independent lookup through the exported shape table
    shapes = {(f, b): s for f, b, _lo, _hi, _c, s in model.shape_rows()}
    bdf = AD.binned(m, bins, keep=["id"]).toPandas()
    exp = np.full(len(bdf), model.intercept)
    for f in QM.FEATURES:
        exp += np.array([shapes[(f, int(b))] for b in bdf[f"b_{f}"]])
    for (a, b), arr in model.pairs.items():
        ca = AD.binned(m, bins, keep=["id"]).select("id", model.coarse(a).alias("ca"), model.coarse(b).alias("cb"))
        cp = ca.toPandas().set_index("id").loc[bdf["id"]]
        exp += arr[cp["ca"].to_numpy(), cp["cb"].to_numpy()]
    got = scored.toPandas().set_index("id").loc[bdf["id"], "pred_log"].to_numpy()
    assert np.allclose(got, exp, atol=1e-9)


def test_oof_each_row_once_and_groups_whole(spark, sf_small):
    folds = QM.group_folds(spark, sf_small).toPandas()
    assert folds.groupby("grp")["fold"].nunique().max() == 1
    oof = QM.oof_predictions(spark, sf_small).toPandas()
    assert oof["id"].is_unique
    assert len(oof) == QM.model_rows(spark, sf_small).count()


def test_unseen_category_scores_zero(spark, sf_small):
    m = QM.model_rows(spark, sf_small)
    bins = AD.fit_binning(m, ["segment"], ["segment"])
    b = bins["segment"]
    row = spark.createDataFrame([("NEVER_SEEN",), (None,)], "segment string").select(b.expr("segment").alias("b"))
    got = [r.b for r in row.collect()]
    assert got == [len(b.cats) + 1, 0]
