"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geodemand.llm.common import mix64, pick, prepare, ragged
from geodemand.llm.components import Forest, connected_components

_ROUNDS = 3
_RANKS = 3


class Scheme(NamedTuple):
    """``tables`` tables of ``functions`` hashes each; a vector stands in ``probes`` buckets of each table."""

    functions: int
    tables: int
    probes: int
    seed: int


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (width a power of two), by sums and differences only."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x


@functools.cache
def _signs(width: int, table: int, function: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width, table, function]).choice((-1.0, 1.0), (_ROUNDS, width))


def bucket_keys(vectors: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Keys (rows, tables, probes) of unit vectors of one dimension.

    A rotation is three rounds of random signs and a Hadamard transform; its hash
    is the nearest vertex of the cross-polytope (largest coordinate and its
    sign). Probes take, for some functions, the second or third vertex, those
    that cost least first. Each row is computed by itself, in a fixed order, so
    keys do not depend on the batch.
    """
    n, dim = vectors.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :dim] = vectors
    ranks = min(_RANKS, width)
    ways = [w for w in product(range(ranks), repeat=scheme.functions) if sum(w) < ranks]
    out = np.empty((n, scheme.tables, scheme.probes), dtype=np.int64)
    for t in range(scheme.tables):
        code = np.zeros((n, len(ways)), dtype=np.uint64)
        cost = np.zeros((n, len(ways)))
        for f in range(scheme.functions):
            y = x
            for signs in _signs(width, t, f, scheme.seed):
                y = hadamard(y * signs) / math.sqrt(width)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :ranks]
            size = np.take_along_axis(size, top, axis=1)
            vertex = (top * 2 + (np.take_along_axis(y, top, axis=1) < 0)).astype(np.uint64)
            choice = [w[f] for w in ways]
            cost += ((size[:, :1] - size) ** 2)[:, choice]
            code = code * np.uint64(2 * width) + vertex[:, choice]
        best = np.argsort(cost, axis=1, kind="stable")[:, :scheme.probes]
        place = mix64(np.array([dim << 20 | t], dtype=np.uint64))
        out[:, t] = mix64(np.take_along_axis(code, best, axis=1) + place).view(np.int64)
    return out


def choose_scheme(n: int, dim: int, threshold: float, recall: float, probes: int = 4, load: int = 64, seed: int = 7) -> Scheme:
    """Scheme for ``n`` vectors: buckets of about ``load`` unrelated vectors at most, and tables enough that a pair
    at the threshold itself is found with probability ``recall`` (measured on 2,000 seeded random pairs)."""
    width = 1 << max(1, (dim - 1).bit_length())
    functions = max(1, math.ceil(math.log(max(1.0, n * probes / load)) / math.log(2 * width)))
    ways = sum(sum(w) < min(_RANKS, width) for w in product(range(min(_RANKS, width)), repeat=functions))
    probes = min(probes, ways)
    rng = np.random.default_rng([seed, dim])
    a, b = rng.normal(size=(2, 2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim > 1:
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * b / np.linalg.norm(b, axis=1, keepdims=True)
    else:
        b = a
    trial = Scheme(functions, 2, probes, seed)
    met = (bucket_keys(a, trial)[:, :, :, None] == bucket_keys(b, trial)[:, :, None, :]).any(axis=(2, 3)).mean()
    met = min(max(float(met), 1e-3), 1 - 1e-9)
    return Scheme(functions, max(2, math.ceil(math.log(1 - recall) / math.log(1 - met))), probes, seed)


class _Partition:
    """Vectors of one dimension in a partition; counts links and unions as pairs are verified."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray, threshold: float, scheme: Scheme):
        self.nodes, self.copies, self.vectors = nodes, copies, vectors
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.threshold, self.scheme = threshold, scheme
        self.links = np.zeros(len(nodes), dtype=np.int64)
        self.forest = Forest(len(nodes))
        self.keys = np.zeros((len(nodes), scheme.tables, scheme.probes), dtype=np.int64)
        self.known = np.zeros(len(nodes), dtype=bool)

    def verify(self, a: np.ndarray, b: np.ndarray, bucket: np.ndarray) -> None:
        cos = np.einsum("ij,ij->i", self.vectors[a], self.vectors[b]) / (self.norms[a] * self.norms[b])
        near = cos >= self.threshold
        self.matched(a[near], b[near], bucket[near])

    def verify_block(self, a: np.ndarray, b: np.ndarray, bucket: int, same: bool) -> None:
        cos = self.vectors[a] @ self.vectors[b].T / (self.norms[a][:, None] * self.norms[b])
        x, y = np.nonzero(np.triu(cos >= self.threshold, 1) if same else cos >= self.threshold)
        for i in range(0, len(x), 1 << 16):
            part = slice(i, i + (1 << 16))
            self.matched(a[x[part]], b[y[part]], np.full(len(x[part]), bucket))

    def matched(self, a: np.ndarray, b: np.ndarray, bucket: np.ndarray) -> None:
        """Union all; count a pair in one bucket only, the first that both stand in."""
        if not len(a):
            return
        self.forest.union(a, b)
        new = np.unique(np.concatenate((a, b)))
        new = new[~self.known[new]]
        self.keys[new] = bucket_keys(self.vectors[new] / self.norms[new][:, None], self.scheme)
        self.known[new] = True
        ka, kb = self.keys[a], self.keys[b]
        met = (ka[:, :, :, None] == kb[:, :, None, :]).any(axis=3)
        table = met.any(axis=2).argmax(axis=1)
        row = np.arange(len(a))
        first = np.where(met[row, table], ka[row, table], np.iinfo(np.int64).max).min(axis=1)
        own = first == bucket
        np.add.at(self.links, a[own], self.copies[b[own]])
        np.add.at(self.links, b[own], self.copies[a[own]])

    def result(self) -> pa.RecordBatch:
        root, member = self.forest.links()
        linked = np.flatnonzero(self.links)
        nothing = np.zeros(0, np.int64)
        a = np.concatenate((self.nodes[root], self.nodes[linked]))
        b = pa.array(np.concatenate((self.nodes[member], linked * 0)), mask=np.arange(len(a)) >= len(root))
        links = np.concatenate((nothing, root * 0, self.links[linked]))
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(links)], names=["a", "b", "links"])


_SMALL = 64
_STEP = 1 << 15
_TILE = 1024


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, schemes: dict[int, Scheme], stored: str) -> Iterator[pa.RecordBatch]:
    held_batches = list(batches)
    if not held_batches:
        return
    table = pa.Table.from_batches(held_batches)
    dims = table["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        part = table.filter(pa.array(dims == dim))
        nodes, at, node = np.unique(part["node"].to_numpy(), return_index=True, return_inverse=True)
        raw = b"".join(part["vec"].take(pa.array(at)).to_pylist())
        vectors = np.frombuffer(raw, dtype=stored).astype(np.float64).reshape(len(nodes), dim)
        held = _Partition(nodes, part["copies"].to_numpy()[at], vectors, threshold, schemes[dim])
        key, pair, side = (part[c].to_numpy() for c in ("key", "pair", "side"))
        order = np.lexsort((side, pair, key))
        key, pair, side, node = key[order], pair[order], side[order], node[order]
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]), [True])))
        size = np.diff(edge)
        split = side[edge[:-1]] != side[edge[1:] - 1]  # blocks of a crowded bucket, compared across
        small = (size <= _SMALL) & ~split
        place = ragged(edge[:-1][small], size[small])
        later = np.repeat(edge[1:][small], size[small]) - place - 1
        done = np.concatenate(([0], np.cumsum(later)))
        i = 0
        while i < len(place):
            j = max(i + 1, int(np.searchsorted(done, done[i] + _STEP, side="right")) - 1)
            a = np.repeat(place[i:j], later[i:j])
            b = ragged(place[i:j] + 1, later[i:j])
            held.verify(node[a], node[b], key[a])
            i = j
        for r in np.flatnonzero(~small).tolist():
            run = node[edge[r]:edge[r + 1]]
            left = right = run
            if split[r]:
                cut = int(np.searchsorted(side[edge[r]:edge[r + 1]], 1))
                left, right = run[:cut], run[cut:]
            for x in range(0, len(left), _TILE):
                for y in range(0 if split[r] else x, len(right), _TILE):
                    held.verify_block(left[x:x + _TILE], right[y:y + _TILE], int(key[edge[r]]), not split[r] and x == y)
        yield held.result()


def _unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None for a null, empty or zero one or one with null or non-finite components."""
    out = []
    for v in column.to_pylist():
        x = None
        if v and None not in v:
            x = np.array(v, dtype="<f8")
            with np.errstate(over="ignore"):
                norm = float(np.dot(x, x))
            if not np.isfinite(x).all() or not 0 < norm < math.inf:
                big = float(np.abs(x).max()) if np.isfinite(x).all() else 0.0
                x = x / big if big else None  # squares out of range: cosine is the same for the scaled vector
        out.append(x)
    return out


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, *, id_col: str = "vec_id", vector_col: str = "embedding",
                     recall: float = 0.99, hot: int = 4096, partition_bytes: int = 64 << 20) -> DataFrame:
    """Links of each vector at cosine ``threshold`` or more, in double precision, and its component.

    Equal vectors are compared once with their number of copies. A vector stands
    in a few buckets of each table (see :func:`bucket_keys`); buckets verify
    their pairs and emit link counts and spanning links only. A pair that shares
    several buckets counts in the first. Crowded buckets (over ``hot``) are
    compared block by block in different tasks, so no bucket, however large, is
    skipped or cut. The scheme follows from the number of vectors
    (:func:`choose_scheme`); ``recall`` is what a pair at the very threshold has,
    closer ones have more; every link returned is verified.

    Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing and are their own component; so do vectors of different
    lengths among each other. A null id is never the smallest; a component of
    null ids has a null component and is not kept. Repeated rows are copies of
    each other. Empty tables give no rows; other columns are ignored. Returns id,
    n_links, component_id and kept.
    """
    spark = vectors.sparkSession
    prepare(spark)
    plain = pick(vectors, id=id_col, v=vector_col)
    kind = plain.schema["id"].dataType.simpleString()
    # single-precision components travel as they are and are widened where they are compared
    stored = "<f4" if plain.schema["v"].dataType.elementType == T.FloatType() else "<f8"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _unit_rows(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if x is None else len(x) for x in rows], pa.int32()),
                 pa.array([None if x is None else (x + 0.0).astype(stored).tobytes() for x in rows], pa.binary())], names=["id", "dim", "vec"])

    rows = plain.mapInArrow(encode, f"id {kind}, dim int, vec binary").checkpoint()
    apart = (rows.where("vec is not null").groupBy("dim", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
             .withColumn("node", F.monotonically_increasing_id()).checkpoint())  # numbered once, then read from files
    sizes = {r.dim: r["count"] for r in apart.groupBy("dim").count().collect()}
    schemes = {dim: choose_scheme(n, dim, threshold, recall) for dim, n in sizes.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                dims = part.column(0).to_numpy()
                for dim in np.unique(dims).tolist():
                    some = part.filter(pa.array(dims == dim))
                    x = np.frombuffer(b"".join(some.column(1).to_pylist()), dtype=stored).astype(np.float64).reshape(-1, dim)
                    keys = bucket_keys(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], schemes[dim]).reshape(len(x), -1)
                    who = pa.array(np.repeat(np.arange(len(x)), keys.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), *(some.column(c).take(who) for c in ("node", "copies", "dim", "vec"))],
                        names=["key", "node", "copies", "dim", "vec"])

    placed = apart.select("dim", "vec", "node", "copies").mapInArrow(
        place, "key long, node long, copies long, dim int, vec binary")
    crowded = (placed.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
               .select("key", F.ceil(F.col("n") / hot).cast("int").alias("parts")).checkpoint())
    if crowded.isEmpty():
        dealt = placed.withColumns({"pair": F.lit(0).cast("long"), "side": F.lit(0)})
    else:
        dealt = placed.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pair = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
        dealt = dealt.withColumns({"pair": pair, "side": (F.col("own") > F.col("other")).cast("int")})
    total = sum(n * schemes[d].tables * schemes[d].probes * (np.dtype(stored).itemsize * d + 48) for d, n in sizes.items())
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // partition_bytes))
    found = (dealt.select("key", "pair", "side", "node", "copies", "dim", "vec").repartition(wide, "key", "pair")
             .mapInArrow(lambda b: _compare(b, threshold, schemes, stored), "a long, b long, links long").checkpoint())
    roots = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = (apart.join(links, apart["node"] == links["a"], "left").join(roots, "node", "left")
             .select("vec", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
    ids = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(ids, "root").select("vec", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("vec is not null").join(known, "vec").select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
