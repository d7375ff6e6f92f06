"""Embedding whitening: FEAST contour integration on the covariance of the distinct vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodemand.llm.common import pick, prepare
from geodemand.llm.vectors import byte_rows, combined, exact_products, longs, matrix_of, whole_vectors

_NODES = 16       # in the upper half of a contour; the lower half is conjugate
_SPARE = 4        # columns beside those that an interval holds
_ROUNDS = 30
_APART = 1e-6     # eigenvalues nearer than this share of the largest lie in one interval


class Interval(NamedTuple):
    centre: float
    radius: float
    count: int


class Components(NamedTuple):
    """Fit of one vector length: count and sums of the distinct vectors, eigenvalues (falling) and unit eigenvectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


# ---- inertia ---------------------------------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a tridiagonal matrix with the inertia of every shift of the symmetric ``matrix``."""
    a = matrix.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        size = float(np.abs(x).max())
        if not size or not np.abs(x[1:]).max():
            continue
        x /= size
        x[0] += math.copysign(float(np.linalg.norm(x)), x[0])
        x /= np.linalg.norm(x)
        below = a[k + 1:, k + 1:]
        p = below @ x
        q = 2 * (p - (x @ p) * x)
        below -= np.outer(x, q) + np.outer(q, x)
        first = a[k + 1:, k] - 2 * (x @ a[k + 1:, k]) * x
        a[k + 1:, k] = a[k, k + 1:] = first
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, side: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues above each shift: positive pivots of the shifted tridiagonal matrix (Sylvester's law of inertia)."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(np.int64)
    for d, s in zip(diagonal[1:], side, strict=True):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - shifts - s * s / pivot
        count += pivot > 0
    return count


def intervals(diagonal: np.ndarray, side: np.ndarray, k: int) -> list[Interval]:
    """Intervals, falling, that hold the ``k`` largest positive eigenvalues and those that cannot be told from the last.

    Each is centred on a group of near eigenvalues and reaches half-way to the
    next one outside. All places are bisected by inertia counts at once.
    """
    reach = np.abs(np.concatenate((side, [0]))) + np.abs(np.concatenate(([0], side)))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    room = (high - low) * 1e-3 + np.finfo(float).tiny
    rank = np.arange(1, len(diagonal) + 1)
    lo, hi = np.full(len(rank), low - room), np.full(len(rank), high + room)
    for _ in range(64):
        mid = (lo + hi) / 2
        up = count_above(diagonal, side, mid) >= rank
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    place = (lo + hi) / 2
    least = place[0] * len(place) * np.finfo(float).eps * 8
    if place[0] <= 0:
        return []
    cut = np.flatnonzero(-np.diff(place) > _APART * place[0]) + 1
    edges = [0, *cut.tolist(), len(place)]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a >= k or place[a] <= least:
            break
        top, bottom = place[a], place[b - 1]
        gaps = [*(place[a - 1:a] - top), *(bottom - place[b:b + 1])]
        radius = (top - bottom) / 2 + (min(gaps) / 2 if gaps else max(abs(top), 1.0) / 4)
        out.append(Interval(float((top + bottom) / 2), float(radius), b - a))
    return out


# ---- contour integration -----------------------------------------------------------------------

def _solves(matrix: np.ndarray, slices: list[Interval], starts: list[np.ndarray]):
    """Task: for each (slice, node), the node's share of the quadrature, a complex shifted solve."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                s, node = divmod(at, _NODES)
                step = slices[s].radius * np.exp(1j * math.pi * (node + 0.5) / _NODES)
                shifted = -matrix.astype(complex)
                shifted[np.diag_indices(len(matrix))] += slices[s].centre + step
                share = (step * np.linalg.solve(shifted, starts[s].astype(complex))).real / _NODES
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([node], pa.int64()),
                                                  pa.array([share.tobytes()], pa.binary())], names=["dim", "part", "m"])
    return run


def _added(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a) + np.frombuffer(b)).tobytes()


def feast(spark: SparkSession, matrix: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest positive eigenvalues of a symmetric matrix, falling, and their unit vectors in columns (fewer if there are fewer).

    Intervals come from inertia counts. A round integrates the resolvent along
    a circle around each interval: one task solves a node's complex shifted
    systems, the shares are added, and Rayleigh-Ritz in the projected columns
    gives pairs. An interval is done when as many pairs lie in it as the
    inertia counts there and their residuals are at rounding size; one that
    never gets there is an error, so no component is missed unnoticed.
    """
    d = len(matrix)
    scale = float(np.abs(matrix).max()) if d else 0.0
    if not scale:
        return np.zeros(0), np.zeros((d, 0))
    matrix = matrix / scale
    diagonal, side = tridiagonal(matrix)
    slices = intervals(diagonal, side, k)
    rng = np.random.default_rng(seed)
    starts = [rng.normal(size=(d, min(d, s.count + _SPARE))) for s in slices]
    found: list[np.ndarray | None] = [None] * len(slices)
    close = 32 * math.sqrt(d) * np.finfo(float).eps
    for _ in range(_ROUNDS):
        todo = [i for i, x in enumerate(found) if x is None]
        if not todo:
            break
        tasks = spark.range(0, len(todo) * _NODES, 1, min(len(todo) * _NODES, max(1, spark.sparkContext.defaultParallelism)))
        shares = tasks.mapInArrow(_solves(matrix, [slices[i] for i in todo], [starts[i] for i in todo]), "dim int, part long, m binary")
        for row in combined(shares, _NODES, _added).collect():
            i = todo[row.dim]
            basis = np.linalg.qr(np.frombuffer(row.m).reshape(d, -1))[0]
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            pairs = basis @ turn
            inside = np.abs(values - slices[i].centre) <= slices[i].radius
            rest = np.linalg.norm(matrix @ pairs[:, inside] - pairs[:, inside] * values[inside], axis=0)
            if inside.sum() == slices[i].count and rest.max() <= close:
                found[i] = pairs[:, inside]
            starts[i] = pairs
    if any(x is None for x in found):
        raise RuntimeError("an eigenvalue interval holds fewer converged components than its inertia count")
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    basis = np.linalg.qr(np.column_stack(found))[0]
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order] * scale, (basis @ turn)[:, order]


# ---- passes over the vectors ---------------------------------------------------------------------

def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            some = batch.column(1) if (dims == dim).all() else batch.column(1).filter(pa.array(dims == dim))
            yield dim, matrix_of(some, dim)


def _rows_of(found: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(found), pa.int64()),
         pa.array(list(found.values()), pa.binary())], names=["dim", "part", "m"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, part, place, n, sum) of a task; sums as text of any length, place -1 only counts."""
    n: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for dim, x in _by_length(batches):
        n[dim] = n.get(dim, 0) + len(x)
        wide = x.size and float(np.abs(x.astype(np.float64)).max()) * len(x) >= 2.0 ** 62
        add = (x.astype(object) if wide else x).sum(axis=0).astype(object)
        sums[dim] = sums[dim] + add if dim in sums else add
    part = TaskContext.get().partitionId()
    rows = [(dim, part, j, n[dim], str(s)) for dim in n for j, s in [(-1, 0), *enumerate(sums[dim].tolist())]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (
        pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["dim", "part", "place", "n", "s"])


def _covariances(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for dim, x in _by_length(batches):
            if dim in centres:
                for i in range(0, len(x), 4096):
                    y = x[i:i + 4096] - centres[dim]
                    sums[dim] = sums.get(dim, 0.0) + y.T @ y
        yield _rows_of({dim: s.tobytes() for dim, s in sums.items()})
    return run


def _squares(x: np.ndarray) -> np.ndarray:
    narrow = not x.size or float(np.abs(x.astype(np.float64)).max()) ** 2 * x.shape[1] < 2.0 ** 62
    return ((x if narrow else x.astype(object)) ** 2).sum(axis=1)


def _project(x: np.ndarray, fit: Components) -> np.ndarray:
    centre = np.array([s / fit.n for s in fit.sums], dtype=float)
    return (x - centre) @ fit.vectors / np.sqrt(fit.values)


def _spread(y: np.ndarray) -> bytes:
    """Count, means and centred products of some rows."""
    mean = y.mean(axis=0)
    z = y - mean
    return np.concatenate(([len(y)], mean, (z.T @ z).ravel())).tobytes()


def _spread_of_both(a: bytes, b: bytes) -> bytes:
    a, b = np.frombuffer(a), np.frombuffer(b)
    k = int((math.isqrt(1 + 4 * (len(a) - 1)) - 1) // 2)
    n, step = a[0] + b[0], b[1:k + 1] - a[1:k + 1]
    products = a[k + 1:] + b[k + 1:] + (np.outer(step, step) * (a[0] * b[0] / n)).ravel()
    return np.concatenate(([n], a[1:k + 1] + step * (b[0] / n), products)).tobytes()


def _spreads(fits: dict[int, Components]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, bytes] = {}
        for dim, x in _by_length(batches):
            if dim in fits:
                part = _spread(_project(x, fits[dim]))
                found[dim] = _spread_of_both(found[dim], part) if dim in found else part
        yield _rows_of(found)
    return run


def fit_components(distinct: DataFrame, k: int) -> tuple[dict[int, Components], int]:
    """Components of each vector length from its distinct vectors (dim, x), and the number of tasks that read these."""
    spark = distinct.sparkSession
    totals = distinct.mapInArrow(_totals, "dim int, part long, place int, n long, s string")
    totals = totals.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("part").alias("part"))
    by_dim: dict[int, dict] = {}
    for r in totals.collect():
        by_dim.setdefault(r.dim, {})[r.place] = r
    sums = {dim: [int(rows[j].s) for j in range(dim)] for dim, rows in by_dim.items()}
    n = {dim: rows[-1].n for dim, rows in by_dim.items()}
    n_parts = 1 + max((rows[-1].part for rows in by_dim.values()), default=0)
    centres = {dim: np.array([s / n[dim] for s in sums[dim]], dtype=float) for dim in sums}
    parts = distinct.mapInArrow(_covariances(centres), "dim int, part long, m binary")
    fits = {}
    for r in combined(parts, n_parts, _added).collect():
        matrix = np.frombuffer(r.m).reshape(r.dim, r.dim) / n[r.dim]
        values, vectors = feast(spark, (matrix + matrix.T) / 2, k)
        fits[r.dim] = Components(n[r.dim], sums[r.dim], values, vectors, float(np.trace(matrix)))
    return fits, n_parts


def identity_errors(distinct: DataFrame, fits: dict[int, Components], n_parts: int) -> dict[int, float]:
    """Largest entry of the covariance of the whitened distinct vectors minus the identity, by vector length."""
    fits = {dim: fit for dim, fit in fits.items() if len(fit.values)}
    out = {}
    for r in combined(distinct.mapInArrow(_spreads(fits), "dim int, part long, m binary"), n_parts, _spread_of_both).collect():
        k = len(fits[r.dim].values)
        found = np.frombuffer(r.m)
        out[r.dim] = float(np.abs(found[k + 1:].reshape(k, k) / found[0] - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, components: int = 4, *, scale: float = 256.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """Each row's vector on the largest principal components, scaled to unit variance.

    Entries c become x = floor(scale * c). Components are fitted on the distinct
    x vectors: exact counts and sums, a covariance of centred products added up
    task by task, its largest eigenvalues by :func:`feast`. Only sums of the
    width of a vector, and its square, reach the driver.

    Returns id, ``dim``, ``n`` (distinct vectors), ``deviation`` (sum over
    dimensions of (n*x - sum)^2, exact; null beyond a long), ``whitened`` and
    ``explained`` (arrays by falling eigenvalue) and ``identity_error`` of the
    fit.

    Rows whose vector is null or holds a null, a non-finite entry or one beyond a
    long once scaled are left out. Vectors of each length are a space of their
    own. Components without variance are not returned (arrays are shorter where
    a space has fewer), so a space of one distinct vector has empty arrays.
    Repeated rows count once in the fit and are all returned; null ids stay.
    Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    plain = pick(vectors, id=id_col, v=vector_col)
    kind = plain.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_vectors(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1]), pa.int32()), byte_rows(x)], names=["dim", "x"])

    distinct = plain.select("v").mapInArrow(encode, "dim int, x binary").distinct().checkpoint()
    fits, n_parts = fit_components(distinct, components)
    errors = identity_errors(distinct, fits, n_parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_vectors(batch.column(1), scale):
                dim = x.shape[1]
                fit = fits[dim]
                n, k = fit.n, len(fit.values)
                whitened = _project(x, fit)
                sums = np.array([fit.sums], dtype=object)
                if max(map(abs, fit.sums), default=0) < 1 << 62:
                    sums = sums.astype(np.int64)
                total = sum(s * s for s in fit.sums)
                deviation = [n * n * q - 2 * n * a + total
                             for q, a in zip(_squares(x).tolist(), exact_products(x, sums)[:, 0].tolist(), strict=True)]
                ends = pa.array(np.arange(len(x) + 1) * k, pa.int32())
                share = np.tile(fit.values / fit.trace, len(x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(x), dim), pa.int32()),
                     pa.array(np.full(len(x), n), pa.int64()), longs(deviation),
                     pa.ListArray.from_arrays(ends, pa.array(whitened.ravel())), pa.ListArray.from_arrays(ends, pa.array(share)),
                     pa.array([errors.get(dim)] * len(x), pa.float64())],
                    names=["id", "dim", "n", "deviation", "whitened", "explained", "identity_error"])

    out = plain.mapInArrow(run, f"id {kind}, dim int, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    return out.withColumnRenamed("id", id_col)


def whitening_digest(found: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row a vector and component."""
    each = found.select(id_col, "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(id_col, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                       F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
