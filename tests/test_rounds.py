"""Boosting rounds by hand: residual histograms, 256 quantile bins, stopping when the loss settles."""

import numpy as np
from pyspark.sql import functions as F

from geodemand.operators import additive as AD


def _rows(spark):
    x = spark.range(3000).select("id", (F.rand(3) * 10).alias("a"), F.when(F.rand(4) < 0.1, None).otherwise(F.rand(5)).alias("b"),
                                 F.element_at(F.array(*map(F.lit, "xyz")), (F.col("id") % 3 + 1).cast("int")).alias("c"))
    return x.withColumn("y", F.sin("a") + F.coalesce("b", F.lit(2.0)) + F.when(F.col("c") == "x", 1.0).otherwise(0.0)).checkpoint()


def test_rounds_equal_numpy(spark):
    m = _rows(spark)
    bins = AD.fit_binning(m, ["a", "b", "c"], ["c"], max_bins=256)
    comp = AD.compress(AD.binned(m, bins, keep=["y"]), ["a", "b", "c"]).checkpoint()
    model = AD.fit_additive(comp, ["a", "b", "c"], bins, rounds=4, learning_rate=0.3, min_leaf=2)
    pdf = AD.binned(m, bins, keep=["y"]).toPandas()
    y, mu = pdf.y.to_numpy(), pdf.y.mean()
    shapes = {f: np.zeros(bins[f].n_bins) for f in "abc"}
    for _ in range(4):
        r = y - mu - sum(shapes[f][pdf[f"b_{f}"]] for f in "abc")
        for f in "abc":
            n = np.bincount(pdf[f"b_{f}"], minlength=len(shapes[f]))
            s = np.bincount(pdf[f"b_{f}"], r, minlength=len(shapes[f]))
            shapes[f] = shapes[f] + np.where(n >= 2, 0.3 * s / np.maximum(n, 1), 0.0)
            mean = (shapes[f] * n).sum() / n.sum()
            shapes[f] -= mean
            mu += mean
    assert np.isclose(model.intercept, mu) and all(np.allclose(model.shapes[f], shapes[f]) for f in "abc")
    assert all(a >= b for a, b in zip(model.history, model.history[1:]))


def test_rounds_stop_when_the_loss_settles(spark):
    m = _rows(spark)
    bins = AD.fit_binning(m, ["a", "b", "c"], ["c"], max_bins=8)
    comp = AD.compress(AD.binned(m, bins, keep=["y"]), ["a", "b", "c"]).checkpoint()
    model = AD.fit_additive(comp, ["a", "b", "c"], bins, rounds=60, learning_rate=0.5, tolerance=1e-3)
    assert 2 < len(model.history) < 60 and model.history[-2] - model.history[-1] <= 1e-3 * model.history[-2]
