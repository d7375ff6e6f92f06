"""Order statistics and quantiles equal numpy's; what reaches the driver stays bounded with ties."""

import numpy as np
import pytest

from geodemand.operators import quantiles as Q


@pytest.mark.parametrize("make", [
    lambda rng: rng.normal(size=3001), lambda rng: np.where(rng.random(4000) < 0.4, 0.0, rng.exponential(size=4000) * 1e6),
    lambda rng: np.full(50, 7.5), lambda rng: np.array([3.0]), lambda rng: np.array([1e300, -1e300, 0.0, 1e-300, 5.0]),
    lambda rng: np.concatenate([rng.integers(0, 5, 2000).astype(float), [1e18, -1e18]])])
def test_quantiles(spark, make):
    x = make(np.random.default_rng(3))
    rows = [(float(v), None if i % 3 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (None, None)], "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = Q.exact_quantiles_multi(df, ["a", "b"], probs)
    assert np.allclose(got["a"], np.quantile(x, probs), rtol=1e-12) and np.allclose(got["b"], np.quantile(x[::3], probs), rtol=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert Q.exact_quantiles(df, "a", [0.5]) == [None]
    assert Q.exact_quantiles(df.limit(0), "a", [0.5]) == [None]


def test_driver_rows_stay_bounded_with_ties(spark, monkeypatch):
    df = spark.range(200_000).selectExpr("if(id % 5 < 2, 0.0, cast(id as double) / 1000) as a").repartition(4).cache()
    seen = []
    narrow = Q._narrow

    def counted(d, brackets):
        out = narrow(d, brackets)
        seen.append(sum(map(len, out.values())))
        return out

    monkeypatch.setattr(Q, "_narrow", counted)
    got = Q.exact_quantiles(df, "a", [0.25, 0.5, 0.75])
    assert np.allclose(got, np.quantile([r.a for r in df.collect()], [0.25, 0.5, 0.75]))
    assert max(seen) <= 6 * Q.BINS
    df.unpersist()
