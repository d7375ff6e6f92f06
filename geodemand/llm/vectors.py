"""Whole-number vectors: reading array columns in Arrow batches, compact bytes, exact inner products, sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SMALL = 1 << 15
_LONG = 2.0 ** 63


def whole_vectors(column: pa.Array, scale: float, most: float = _LONG) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of longs floor(scale * c)) for each vector length among the rows that take part.

    A row takes no part if its vector is null or holds a null, a non-finite
    component or one outside [-most, most) once scaled (by default, beyond a long).
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # without the rows that are null
    with np.errstate(over="ignore", invalid="ignore"):
        value = np.floor(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
        good = (value >= -most) & (value < most)
    size = np.maximum(lengths, 0)
    ends = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(~good)))
    takes = (lengths >= 0) & (bad[ends] == bad[ends - size])
    for dim in np.unique(lengths[takes]).tolist():
        rows = np.flatnonzero(takes & (lengths == dim))
        at = (ends - size)[rows]
        yield rows, value[at[:, None] + np.arange(dim)].astype(np.int64).reshape(len(rows), dim)


def byte_rows(matrix: np.ndarray) -> pa.Array:
    """Bytes of each row, as 2-byte integers where all fit, else as longs: equal rows have equal bytes."""
    n, dim = matrix.shape
    if not dim:
        return pa.array([b""] * n, pa.binary())
    narrow = ((matrix < _SMALL) & (matrix >= -_SMALL)).all(axis=1)
    if narrow.all():
        return _fixed(np.ascontiguousarray(matrix, dtype="<i2"))
    short, wide = iter(_fixed(matrix[narrow].astype("<i2")).to_pylist()), iter(_fixed(matrix[~narrow].astype("<i8")).to_pylist())
    return pa.array([next(short) if x else next(wide) for x in narrow.tolist()], pa.binary())


def _fixed(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(matrix), [None, pa.py_buffer(matrix)]).cast(pa.binary())


def matrix_of(rows: pa.Array, dim: int) -> np.ndarray:
    """The longs of :func:`byte_rows`, rows of one length."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    out = np.empty((len(rows), dim), dtype=np.int64)
    if not dim or not len(rows):
        return out
    off = np.frombuffer(rows.buffers()[1], dtype=np.int32)[rows.offset:rows.offset + len(rows) + 1].astype(np.int64)
    raw = np.frombuffer(rows.buffers()[2], dtype=np.uint8)
    wide = np.diff(off) == 8 * dim
    for kind, some in (("<i2", np.flatnonzero(~wide)), ("<i8", np.flatnonzero(wide))):
        if len(some):
            step = dim * np.dtype(kind).itemsize
            if len(some) == len(rows):
                out[:] = raw[off[0]:off[-1]].view(kind).reshape(-1, dim)
            else:
                out[some] = np.ascontiguousarray(raw[off[some][:, None] + np.arange(step)]).view(kind)
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, exact: in doubles or longs where these hold all
    partial sums, else in Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).sum(axis=1).max())
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0 ** 62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def longs(values) -> pa.Array:
    """Integers as longs; those beyond a long are null."""
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())


def combined(parts: DataFrame, n_parts: int, merge: Callable[[bytes, bytes], bytes], fan: int = 16) -> DataFrame:
    """(dim, part, m): one value a length out of one a task and length, merged ``fan`` at a time in the order of the tasks.

    No group holds more than ``fan`` values, whatever the number of tasks.
    """
    def fold(key, group):
        values = group.sort_values("sub")["m"].tolist()
        out = values[0]
        for v in values[1:]:
            out = merge(out, v)
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "m": [out]})

    while n_parts > 1:
        grouped = parts.select("dim", F.col("part").alias("sub"), F.floor(F.col("part") / fan).cast("long").alias("part"), "m")
        parts = grouped.groupBy("dim", "part").applyInPandas(fold, "dim int, part long, m binary")
        n_parts = -(-n_parts // fan)
    return parts
