"""Whitening against dense eigenvectors; contour integration and inertia counts by themselves."""

import math

import numpy as np
import pytest

from geodemand.llm.common import pick
from geodemand.llm.queries import op11_whitening
from geodemand.llm.vectors import byte_rows, exact_products, matrix_of
from geodemand.llm.whitening import count_above, feast, intervals, tridiagonal, whiten, whitening_digest

SCHEMA = "vec_id long, embedding array<double>, label int, Embedding string, dim int, n long, x binary, part long"


def rows_of(vectors, ids=None):
    return [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], 0, "clash", 1, 2, b"", 3)
            for i, v in enumerate(vectors)]


def table(spark, vectors, ids=None):
    return spark.createDataFrame(rows_of(vectors, ids), SCHEMA)


def spread_matrix(values, rng):
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("size", [1, 2, 3, 17, 48])
def test_inertia_counts_equal_dense_eigenvalues(size):
    rng = np.random.default_rng(size)
    for matrix in (rng.normal(size=(size, size)), np.diag(rng.integers(0, 3, size).astype(float)), np.ones((size, size))):
        matrix = matrix + matrix.T
        values = np.linalg.eigvalsh(matrix)
        shifts = rng.uniform(values[0] - 1, values[-1] + 1, 300)
        shifts = shifts[np.abs(shifts[:, None] - values).min(axis=1) > 1e-9]
        assert (count_above(*tridiagonal(matrix), shifts) == (values > shifts[:, None]).sum(axis=1)).all()


def test_intervals_hold_groups_of_near_eigenvalues():
    values = np.array([9.0, 5.0, 5.0 - 1e-9, 4.0, 4.0, 1.0, 0.0])
    found = intervals(np.sort(values), np.zeros(6), 4)
    assert [i.count for i in found] == [1, 2, 2]
    for i in found:
        assert (np.abs(values - i.centre) < i.radius).sum() == i.count


@pytest.mark.parametrize("values", [
    [10, 5, 4.99, 4.98, 3, 2, 1, 0.5], [7, 7, 7, 7, 7, 7], [3, 2, 0, 0, 0], [1e12, 1e6, 1, 1e-3], [2, 1 + 1e-5, 1, 1 - 1e-5, 0.5],
    list(np.linspace(1.0, 1.2, 40)), [0, 0, 0], [5]])
def test_contour_integration_equals_dense_eigenvectors(spark, values):
    rng = np.random.default_rng(len(values))
    matrix = spread_matrix(np.array(values, dtype=float), rng)
    got, vectors = feast(spark, matrix, 4)
    want = sorted((v for v in values if v > 0), reverse=True)[:4]
    assert len(got) == len(want)
    if want:
        assert np.abs(got - want).max() <= 1e-12 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12
        assert np.abs(matrix @ vectors - vectors * got).max() <= 1e-11 * want[0]


def check(spark, vectors, k=4, scale=256.0):
    got = whitening_digest(whiten(table(spark, vectors), k, scale=scale)).collect()
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, []).append(r)
    good = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) and abs(c * scale) < 2**63 for c in v)]
    whole = {i: tuple(math.floor(scale * c) for c in vectors[i]) for i in good}
    for dim in {len(x) for x in whole.values()}:
        own = {i: x for i, x in whole.items() if len(x) == dim}
        fit = sorted(set(own.values()))
        n = len(fit)
        sums = [sum(c) for c in zip(*fit, strict=True)]
        centred = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in fit]).reshape(n, dim)
        matrix = centred.T @ centred / n
        values = np.linalg.eigvalsh(matrix)[::-1] if dim else np.zeros(0)
        positive = values[values > 1e-12 * max(values, default=0)][:k] if n > 1 else values[:0]
        for i, x in own.items():
            rows = sorted(by_row.get(i, []), key=lambda r: r.component)
            assert [r.component for r in rows] == list(range(1, len(positive) + 1))
            assert all(r.n == n for r in rows)
            deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
            assert all(r.deviation == (deviation if deviation < 2**63 else None) for r in rows)
            assert all(abs(r.explained - v / values.sum()) < 1e-9 for r, v in zip(rows, positive, strict=True))
        if len(positive):
            # scores of the distinct vectors: unit covariance, and along the matrix's own eigenvectors
            index = {x: i for i, x in own.items()}
            y = np.array([[r.whitened for r in sorted(by_row[index[x]], key=lambda r: r.component)] for x in fit])
            assert np.abs(y.T @ y / n - np.eye(len(positive))).max() < 1e-8
            back = centred.T @ y / n / np.sqrt(positive)  # the unit vectors
            assert np.abs(matrix @ back - back * positive).max() < 1e-7 * positive[0]
            assert max(r.identity_error for i in own for r in by_row[i]) < 1e-8
    assert set(by_row) <= set(good)
    return got


def test_against_dense_linear_algebra(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 9)) @ np.diag([3, 2, 1.5, 1, 0.9, 0.5, 0.2, 0.1, 0.05])
    check(spark, [*x, *x[:30], x[0], x[0]])
    check(spark, list(rng.normal(size=(50, 3))), k=5)


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    vectors = [*rng.normal(size=(12, 4)), None, [1.0, None, 2.0, 3.0], [math.nan, 0, 0, 0], [math.inf, 0, 0, 0], [1e300, 0, 0, 0],
               [], [], *rng.normal(size=(7, 2)), [5.0], [5.0], [0.0, 0.0, 0.0], [-0.0, 0.0, 0.0]]
    check(spark, [None if v is None else list(v) for v in vectors])
    ids = [None, 1, 1, 2]
    got = whiten(table(spark, [[1, 2], [3, 4], [3, 4], [0, 9]], ids), 2).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n) for r in got) == [(False, 1, 3), (False, 1, 3), (False, 2, 3), (True, 0, 3)]


def test_values_beyond_doubles_stay_exact(spark):
    big = [[2.0**50, 1.0], [2.0**50 + 1, 2.0], [2.0**50 + 2, 5.0], [-(2.0**50), 3.0]]
    check(spark, big)
    check(spark, [[2.0**20, 1.0], [2.0**20 + 0.5, 2.0], [2.0**20 + 1, 5.0]])


def test_equal_eigenvalues_and_large_offsets(spark):
    axes = np.vstack([np.eye(5), -np.eye(5)]) * 4
    check(spark, list(axes + 1000.0))
    check(spark, list(np.round(np.random.default_rng(1).normal(size=(60, 6))) + 3e6), scale=1.0)


def test_empty_table_and_registered_query(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening_digest(whiten(empty)).collect() == []
    rng = np.random.default_rng(6)
    rows = pick(table(spark, list(rng.normal(size=(40, 8)))), vec_id="vec_id", embedding="embedding", label="label")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op11_whitening(spark, str(tmp_path)).count() == 160


def test_byte_rows_and_exact_products():
    rng = np.random.default_rng(7)
    x = rng.integers(-300, 300, (20, 5))
    x[3, 2], x[7, 0] = 1 << 40, -(1 << 62)
    assert (matrix_of(byte_rows(x), 5) == x).all()
    assert (matrix_of(byte_rows(x).slice(2, 6), 5) == x[2:8]).all()
    want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in x]
    assert exact_products(x, x).tolist() == want
