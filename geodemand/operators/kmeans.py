"""Geographic groups: k-means on (lat, lon), all restarts advancing together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodemand.operators.rows import spread

_SEEDS = 4096  # rows that the starting centres are drawn from


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def _starting_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn in proportion to its squared distance from those drawn before."""
    out = [x[rng.integers(len(x))]]
    while len(out) < k:
        far = _distances(x, np.array(out)).min(axis=1)
        out.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
    return np.array(out)


def _sums(centres: np.ndarray):
    """Task: rows, sums of coordinates and squared distances by (restart, cluster)."""
    restarts, k, _ = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((restarts, k, 4))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = np.column_stack([c.slice(i, 4096).to_numpy() for c in batch.columns])
                for r in range(restarts):
                    far = _distances(x, centres[r])
                    near = far.argmin(axis=1)
                    for j, w in enumerate((None, x[:, 0], x[:, 1], far[np.arange(len(x)), near])):
                        total[r, :, j] += np.bincount(near, w, k)
        r, c = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(c, pa.int32()), *(pa.array(total[r, c, j]) for j in range(4))],
                                         names=["r", "c", "n", "lat", "lon", "cost"])
    return run


def fit_centres(df: DataFrame, k: int = 20, seed: int = 42, restarts: int = 10, lat: str = "lat", lon: str = "lon",
                tolerance: float = 1e-4) -> np.ndarray:
    """Centres (k, 2) of the restart with the lowest cost; first restart of equals.

    Starting centres are drawn on a bounded sample (the rows of the smallest
    hashes). A step is one scan: every task adds up its rows for the centres of
    all restarts that still move, and restarts x k sums reach the driver. A
    restart ends when its centres move less than ``tolerance`` of the coordinates'
    spread. A cluster that loses all rows keeps its centre. Rows without
    coordinates take no part; fewer than k distinct rows give centres that coincide.
    """
    rows = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    rows = spread(rows, "lat", "lon").checkpoint()
    sample = np.array([(r.lat, r.lon) for r in rows.orderBy(F.xxhash64("lat", "lon", F.lit(seed)), "lat", "lon").limit(_SEEDS).collect()])
    if not len(sample):
        return np.zeros((0, 2))
    centres = np.stack([_starting_centres(sample, k, np.random.default_rng([seed, i])) for i in range(restarts)])
    extent = float(sample.var(axis=0).mean())
    cost = np.full(restarts, np.inf)
    moving = np.arange(restarts)
    while len(moving):
        found = rows.mapInArrow(_sums(centres[moving]), "r int, c int, n double, lat double, lon double, cost double")
        found = found.groupBy("r", "c").agg(*[F.sum(x).alias(x) for x in ("n", "lat", "lon", "cost")]).collect()
        old = centres[moving]
        new, here = old.copy(), np.zeros(len(moving))
        for s in found:
            new[s.r, s.c] = s.lat / s.n, s.lon / s.n
            here[s.r] += s.cost
        cost[moving] = here
        centres[moving] = new
        moving = moving[((new - old) ** 2).sum(axis=(1, 2)) > tolerance * extent]
    return centres[int(cost.argmin())]


def with_group(df: DataFrame, centres: np.ndarray, out: str = "grp", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``df`` with the number of the nearest centre (smallest of equals); -1 without coordinates."""
    if not len(centres):
        return df.withColumn(out, F.lit(-1))
    far = [F.struct(((F.col(lat) - float(a)) * (F.col(lat) - float(a)) + (F.col(lon) - float(b)) * (F.col(lon) - float(b))).alias("d"),
                    F.lit(i).alias("i")) for i, (a, b) in enumerate(centres.tolist())]
    nearest = F.array_min(F.array(*far))["i"]
    return df.withColumn(out, F.when(F.col(lat).isNull() | F.col(lon).isNull(), -1).otherwise(nearest).cast("int"))
