"""Hard-negative mining: candidates in Hilbert-curve order, cut to Parquet blocks with zone maps that bound inner products."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geodemand.llm.common import pick, prepare, shared_folder
from geodemand.llm.vectors import byte_rows, combined, exact_products, matrix_of, whole_vectors

_AXES, _BITS = 16, 4          # of the curve: 64 bits
_RUN = 1 << 16                # rows of a range of the curve
_BLOCK, _TILE = 1024, 256     # candidates of a block, anchors of a tile
_CHUNK, _GROUP = 16, 32       # blocks and tiles that meet in one group
_MOST = 2.0 ** 56             # of a component: a score of up to 2^13 of them has 38 digits


class Mining(NamedTuple):
    """``positives`` a anchor, ``negatives`` a positive with low/unit <= negative score / positive score <= high/unit."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    unit: int = 100


# ---- the curve -------------------------------------------------------------------------------

def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``bits``-bit coordinates on the Hilbert curve, as unsigned numbers (at most 64 bits in all)."""
    x = [cells[:, j].astype(np.uint64) for j in range(cells.shape[1])]
    if not x:
        return np.zeros(len(cells), dtype=np.uint64)
    for b in range(bits - 1, 0, -1):  # undo the turns of the sub-cubes, coarse to fine
        bit, rest = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for j in range(len(x)):
            flip = (x[j] & bit) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[j]) & rest)
            x[0] = np.where(flip, x[0] ^ rest, x[0] ^ swap)
            x[j] = x[j] ^ swap if j else x[0]
    for j in range(1, len(x)):
        x[j] = x[j] ^ x[j - 1]
    turn = np.zeros(len(cells), dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint64(1 << b), np.uint64((1 << b) - 1), np.uint64(0))
    out = np.zeros(len(cells), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << np.uint64(1) | ((v ^ turn) >> np.uint64(b)) & np.uint64(1)
    return out


class Frame(NamedTuple):
    """Axes of the curve for one vector length, the most spread first, and the range of each."""

    axes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def keys(self, x: np.ndarray) -> np.ndarray:
        part = x[:, self.axes].astype(np.float64)
        cell = np.floor((part - self.low) / (self.high - self.low + 1) * (1 << _BITS)).clip(0, (1 << _BITS) - 1)
        return (hilbert(cell, _BITS) ^ np.uint64(1 << 63)).view(np.int64)  # signed order is the unsigned one


def _extent(x: np.ndarray) -> bytes:
    y = x.astype(np.float64)
    return np.concatenate(([len(y)], y.min(axis=0), y.max(axis=0), y.sum(axis=0), (y * y).sum(axis=0))).tobytes()


def _extent_of_both(a: bytes, b: bytes) -> bytes:
    a, b = np.frombuffer(a), np.frombuffer(b)
    d = len(a) // 4
    return np.concatenate((a[:1] + b[:1], np.minimum(a[1:d + 1], b[1:d + 1]), np.maximum(a[d + 1:2 * d + 1], b[d + 1:2 * d + 1]),
                           a[2 * d + 1:] + b[2 * d + 1:])).tobytes()


def _frame(extent: bytes) -> tuple[int, Frame]:
    e = np.frombuffer(extent)
    n, (low, high, total, squares) = e[0], e[1:].reshape(4, -1)
    spread = squares / n - (total / n) ** 2
    axes = np.argsort(-spread, kind="stable")[:_AXES]
    return int(n), Frame(axes, low[axes], high[axes])


# ---- blocks ----------------------------------------------------------------------------------

_BLOCK_FIELDS = [("part", pa.int64()), ("block", pa.int64()), ("dim", pa.int32()), ("label", pa.string()), ("lo", pa.binary()), ("hi", pa.binary()),
                 ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("slots", pa.list_(pa.int32())), ("ax", pa.binary()),
                 ("seeds", pa.list_(pa.int64()))]
_TILE_FIELDS = [("part", pa.int64()), ("tile", pa.int64()), ("dim", pa.int32()), ("label", pa.string()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()),
                ("homes", pa.list_(pa.int64())), ("slots", pa.list_(pa.int32())), ("seeds", pa.list_(pa.int64()))]
_SPARK = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>",
          pa.list_(pa.int32()): "array<int>"}


def _ddl(fields) -> str:
    return ", ".join(f"{name} {_SPARK[kind]}" for name, kind in fields)


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _whole(x: np.ndarray) -> bytes:
    """All rows in one piece, narrow if they fit."""
    narrow = not x.size or (x.max() < 1 << 15 and x.min() >= -(1 << 15))
    return (b"s" if narrow else b"l") + x.astype("<i2" if narrow else "<i8").tobytes()


def _unwhole(raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i2" if raw[:1] == b"s" else "<i8", offset=1).astype(np.int64).reshape(n, dim)


def _cut(how: Mining, block_rows: int):
    """Sorted rows to blocks of one length and label. An anchor's seed: a score that as many others of its block reach as it needs positives."""
    def block(part: int, number: int, dim: int, label: str, ids: pa.Array, x: np.ndarray) -> tuple:
        whole = ids.fill_null(1).to_numpy()
        slots = np.flatnonzero(whole % how.every == 0)
        seeds: list = [None] * len(slots)
        if len(x) > how.positives:
            scores = exact_products(x[slots], x)
            for i, s in enumerate(slots.tolist()):
                seed = int(np.sort(np.delete(scores[i], s))[-how.positives])
                seeds[i] = min(seed, (1 << 63) - 1) if seed >= -(1 << 63) else None  # a lower bound will do
        return (part, part << 32 | number, dim, label, _whole(x.min(axis=0)[None]), _whole(x.max(axis=0)[None]), ids.to_pylist(),
                _whole(x), slots.tolist(), _whole(x[slots]), seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            kind = np.array([f"{d}:{lab}" for d, lab in zip(rows["dim"].to_pylist(), rows["label"].to_pylist(), strict=True)])
            edges = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
            for a, b in zip(edges, edges[1:], strict=False):
                for i in range(a, b, block_rows):
                    some = rows.slice(i, min(block_rows, b - i))
                    if not last and b == len(kind) and i + block_rows >= b:
                        held = some.combine_chunks().to_batches()  # may go on in the next batch
                        return
                    dim = some["dim"][0].as_py()
                    yield _batch([block(part, number, dim, some["label"][0].as_py(), some["id"].combine_chunks(), matrix_of(some["x"], dim))], _BLOCK_FIELDS)
                    number += 1
            held = []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) > block_rows:
                    yield from flush(pa.Table.from_batches(held), False)
        if held:
            yield from flush(pa.Table.from_batches(held), True)
    return run


def _tiles(tile_rows: int):
    """Anchors of a task's blocks, gathered to tiles of one length and label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: dict[tuple, list] = {}

        def tile(kind: tuple, rows: list) -> tuple:
            nonlocal number
            number += 1
            x = np.concatenate([r[1][None] for r in rows])
            return (part, part << 32 | (number - 1), *kind, [r[0] for r in rows], _whole(x), [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows])

        for batch in batches:
            for r in batch.to_pylist():
                rows = held.setdefault((r["dim"], r["label"]), [])
                x = _unwhole(r["ax"], r["dim"], len(r["slots"]))
                rows += zip([r["ids"][s] for s in r["slots"]], x, [r["block"]] * len(x), r["slots"], r["seeds"], strict=True)
                while len(rows) >= tile_rows:
                    yield _batch([tile((r["dim"], r["label"]), rows[:tile_rows])], _TILE_FIELDS)
                    del rows[:tile_rows]
        for kind, rows in held.items():
            if rows:
                yield _batch([tile(kind, rows)], _TILE_FIELDS)
    return run


def _numbered(df: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, int]:
    """``df`` with ``name``, its rows in the order of ``key`` dealt ``size`` at a time; and how many such groups there are."""
    counts = df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one a task
    first, firsts = 0, []
    for r in counts:
        firsts.append((r.part, first))
        first += r.n
    offsets = df.sparkSession.createDataFrame(firsts, "part long, first long")
    number = F.col("first") + F.col(key).bitwiseAND((1 << 32) - 1)
    return df.join(F.broadcast(offsets), "part").withColumn(name, F.floor(number / size).cast("long")).drop("first", "part"), -(-first // size)


# ---- bounds and scores -----------------------------------------------------------------------

class _Tile:
    def __init__(self, r: dict):
        n = len(r["homes"])
        self.tile, self.dim, self.label, self.n = r["tile"], r["dim"], r["label"], n
        self.x = _unwhole(r["x"], r["dim"], n)
        self.up, self.down = np.maximum(self.x, 0), np.minimum(self.x, 0)
        self.homes, self.slots = np.array(r["homes"]), np.array(r["slots"])
        self.low, self.high = self.spans(r)

    def spans(self, r: dict) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score that counts for each anchor and request (object: no overflow, None never); high < low: no request."""
        raise NotImplementedError

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with anything in each box, by interval arithmetic."""
        return (exact_products(self.up, lo) + exact_products(self.down, hi),
                exact_products(self.up, hi) + exact_products(self.down, lo))


_FAR = 1 << 130


class _ForPositives(_Tile):
    same = True

    def spans(self, r):
        low = [[-_FAR if s is None else s] for s in r["seeds"]]
        return np.array(low, dtype=object).reshape(self.n, 1), np.full((self.n, 1), _FAR, dtype=object)


def _for_negatives(how: Mining):
    class ForNegatives(_Tile):
        same = False

        def spans(self, r):
            low = np.full((self.n, how.positives), 1, dtype=object)
            high = np.zeros((self.n, how.positives), dtype=object)
            for w in r["windows"]:
                score = int(w["score"])
                low[w["slot"], w["at"]] = -(-how.low * score // how.unit)
                high[w["slot"], w["at"]] = how.high * score // how.unit
            return low, high
    return ForNegatives


def _needed(tile: _Tile, lo: np.ndarray, hi: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(anchor, request, box): whether the box may hold a score from ``low`` to the tile's ``high``."""
    least, most = tile.bounds(lo, hi)
    return ((most[:, None, :] >= low[:, :, None]) & (least[:, None, :] <= tile.high[:, :, None])
            & (tile.low <= tile.high)[:, :, None]).astype(bool)


def _kinds(blocks: list[dict], tile: _Tile) -> list[int]:
    return [i for i, b in enumerate(blocks) if b["dim"] == tile.dim and (b["label"] == tile.label) == tile.same]


def _boxes(blocks: list[dict], some: list[int], dim: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.zeros((0, dim), np.int64), *(_unwhole(blocks[i][c], dim, 1) for i in some)]) for c in ("lo", "hi"))


def _choose(tile_type):
    """Blocks of a chunk that some anchor of the group must read."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        zones = right.to_pylist()
        wanted = np.zeros(len(zones), dtype=bool)
        for r in left.to_pylist():
            tile = tile_type(r)
            some = [i for i in _kinds(zones, tile) if not wanted[i]]
            if some:
                wanted[some] |= _needed(tile, *_boxes(zones, some, tile.dim), tile.low).any(axis=(0, 1))
        group = left["group"][0].as_py() if left.num_rows else 0
        blocks = [zones[i]["block"] for i in np.flatnonzero(wanted).tolist()]
        return pa.table({"group": pa.array([group] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.int64())})
    return run


class _Best:
    """The first ``k`` candidates of each (anchor, request): higher scores first, ties by smaller id, null ids last."""

    def __init__(self, n: int, requests: int, k: int):
        self.k = k
        self.score = np.full((n, requests, k), -_FAR, dtype=object)
        self.id = np.zeros((n, requests, k), dtype=np.int64)
        self.null = np.zeros((n, requests, k), dtype=bool)
        self.wide = False

    def worst(self) -> np.ndarray:
        return self.score[:, :, -1]

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score = np.concatenate((self.score[rows], score), axis=2)
        ids = np.concatenate((self.id[rows], ids), axis=2)
        null = np.concatenate((self.null[rows], null), axis=2)
        minus = -score
        if abs(minus[minus < _FAR]).max(initial=0) < 1 << 62:
            minus = np.where(minus == _FAR, 1 << 62, minus).astype(np.int64)
        else:
            minus = np.unique(minus, return_inverse=True)[1].reshape(minus.shape)  # its order is all that counts
        order = np.lexsort((ids, null, minus), axis=-1)[:, :, :self.k]
        self.score[rows], self.id[rows], self.null[rows] = (np.take_along_axis(a, order, axis=2) for a in (score, ids, null))


def _first_in_spans(scores: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, column) of the first ``k`` columns of each row whose score lies in each span; columns come by rank of their ids.

    Absent ones have score -_FAR and column 0.
    """
    n = scores.shape[1]
    if not n:
        return np.full((*low.shape, k), -_FAR, dtype=object), np.zeros((*low.shape, k), dtype=np.int64)
    wide = scores.dtype == object or float(np.abs(scores).max(initial=0)) * n >= 2.0 ** 61
    key = (scores.astype(object) if wide else scores) * n + (n - 1 - np.arange(n))
    key.sort(axis=1)
    if not wide:
        low, high = (np.clip(a, -(1 << 61) // n, (1 << 61) // n).astype(np.int64) for a in (low, high))
    first = np.stack([(key < low[:, r, None] * n).sum(axis=1) for r in range(low.shape[1])], axis=1)
    end = np.stack([(key < (high[:, r, None] + 1) * n).sum(axis=1) for r in range(low.shape[1])], axis=1)
    at = end[:, :, None] - 1 - np.arange(k)
    found = at >= first[:, :, None]
    value = np.take_along_axis(key[:, None, :], np.maximum(at, 0), axis=2)
    return np.where(found, (value // n).astype(object), -_FAR), np.where(found, n - 1 - (value % n).astype(np.int64), 0)


def _read(tile_type, k: int):
    """First ``k`` candidates of each request among the chosen blocks of a chunk.

    Blocks are read by falling upper bound; one is passed over by the anchors
    whose requests are already filled with scores above that bound.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = right.to_pylist()
        ready = {}
        out = []
        for r in left.to_pylist():
            tile = tile_type(r)
            some = _kinds(blocks, tile)
            if not some:
                continue
            lo, hi = _boxes(blocks, some, tile.dim)
            most = tile.bounds(lo, hi)[1].max(axis=0)
            best = _Best(tile.n, tile.low.shape[1], k)
            for j in np.argsort(-most, kind="stable").tolist():
                i = some[j]
                low = np.maximum(tile.low, best.worst())
                rows = np.flatnonzero(_needed(tile, lo[j:j + 1], hi[j:j + 1], low).any(axis=(1, 2)))
                if not len(rows):
                    continue
                if i not in ready:
                    ids = pa.array(blocks[i]["ids"], pa.int64())
                    null, whole = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                    by_id = np.lexsort((whole, null))
                    ready[i] = _unwhole(blocks[i]["x"], tile.dim, len(whole))[by_id], whole[by_id], null[by_id], np.argsort(by_id)
                x, whole, null, place = ready[i]
                scores = exact_products(tile.x[rows], x)
                own = tile.homes[rows] == blocks[i]["block"]
                high = tile.high[rows]
                if own.any() and tile.same:  # the anchor itself
                    for a in np.flatnonzero(own).tolist():
                        at = place[tile.slots[rows[a]]]
                        others = np.arange(len(x)) != at
                        score, column = _first_in_spans(scores[a:a + 1, others], low[rows[a]][None], high[a:a + 1], k)
                        if others.any():
                            column = np.flatnonzero(others)[column]
                        best.add(rows[a:a + 1], score, whole[column], null[column])
                    rows, scores, high = rows[~own], scores[~own], high[~own]
                if len(rows):
                    score, column = _first_in_spans(scores, low[rows], high, k)
                    best.add(rows, score, whole[column], null[column])
            slot, at, place = np.nonzero(best.score != -_FAR)
            out.append(pa.table({
                "tile": pa.array(np.full(len(slot), tile.tile)), "slot": pa.array(slot, pa.int32()), "at": pa.array(at, pa.int32()),
                "score": pa.array([Decimal(s) for s in best.score[slot, at, place].tolist()], pa.decimal128(38, 0)), "id": pa.array(best.id[slot, at, place], mask=best.null[slot, at, place])}))
        schema = pa.schema([("tile", pa.int64()), ("slot", pa.int32()), ("at", pa.int32()), ("score", pa.decimal128(38, 0)), ("id", pa.int64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()
    return run


def _search(spark: SparkSession, tiles: DataFrame, groups: int, blocks: DataFrame, chunks: int, tile_type, k: int) -> DataFrame:
    """(tile, slot, at, score, id, rank): the first ``k`` candidates of each request of each anchor.

    Zone maps alone meet the tiles first; then only chosen blocks are sent to the groups of tiles that chose them.
    """
    grid = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))))
    dealt = grid(tiles, "chunk", chunks)
    zones = grid(blocks.select("block", "dim", "label", "lo", "hi", "chunk"), "group", groups)
    chosen = (dealt.groupBy("group", "chunk").cogroup(zones.groupBy("group", "chunk"))
              .applyInArrow(_choose(tile_type), "group long, block long").checkpoint())
    sent = blocks.select("block", "dim", "label", "lo", "hi", "ids", "x", "chunk").join(chosen, "block")
    met = sent.select("group", "chunk").distinct()
    sent = sent.toDF(*sent.columns)  # attributes of its own, as both sides of the next step come from it
    found = (tiles.join(met, "group").groupBy("group", "chunk").cogroup(sent.groupBy("group", "chunk"))
             .applyInArrow(_read(tile_type, k), "tile long, slot int, at int, score decimal(38,0), id long"))
    order = Window.partitionBy("tile", "slot", "at").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, how: Mining = Mining(), *, scale: float = 256.0, id_col: str = "vec_id",  # noqa: B008
                        label_col: str = "label", vector_col: str = "embedding", block_rows: int = _BLOCK, tile_rows: int = _TILE) -> DataFrame:
    """Hard negatives of every anchor (id divisible by ``how.every``) and positive.

    Components become floor(scale * c); scores are exact integer inner products,
    higher first, ties by smaller id (null ids last). An anchor's positives are
    its first ``how.positives`` other rows of its label; a positive's negatives
    the first ``how.negatives`` rows of other labels whose score lies between
    low/unit and high/unit of the positive's.

    Candidates are sorted by length, label and their place on a Hilbert curve
    over the most spread axes, and written as Parquet blocks with the least and
    largest value of each dimension. Interval arithmetic on these boxes bounds
    every score of a block. An anchor reads a block for positives only if the
    bound reaches the score that enough rows of its own block have, and for
    negatives only if the bounds meet one of its windows. Blocks and tiles of
    anchors meet in groups of bounded size, whatever labels or vectors repeat.

    Rows with a null label or vector, or with a null or non-finite component or
    one of 2^56 or more once scaled, take no part. Null ids are no anchors. Vectors of other
    lengths never meet. Repeated anchors are anchors each, and candidates for
    each other. A score beyond a long counts as it is and is returned as null. Empty tables give no rows; other
    columns are ignored. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    spark = vectors.sparkSession
    prepare(spark)
    plain = pick(vectors, id=id_col, label=label_col, v=vector_col).select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "v")
    plain = plain.where("label is not null")

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, bytes] = {}
        for batch in batches:
            for _, x in whole_vectors(batch.column(0), scale, _MOST):
                part = _extent(x)
                found[x.shape[1]] = _extent_of_both(found[x.shape[1]], part) if x.shape[1] in found else part
        yield _batch([(d, TaskContext.get().partitionId(), m) for d, m in found.items()], [("dim", pa.int32()), ("part", pa.int64()), ("m", pa.binary())])

    parts = plain.select("v").mapInArrow(extents, "dim int, part long, m binary").checkpoint()
    tasks = 1 + (parts.agg(F.max("part")).first()[0] or 0)
    frames = {r.dim: _frame(r.m) for r in combined(parts, tasks, _extent_of_both).collect()}
    n = sum(count for count, _ in frames.values())
    answer = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], answer)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_vectors(batch.column(2), scale, _MOST):
                dim = x.shape[1]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(x), dim), pa.int32()),
                                                  byte_rows(x), pa.array(frames[dim][1].keys(x))], names=["id", "label", "dim", "x", "place"])

    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block_rows)), -(-n // _RUN))
    keys = ["dim", "label", "place", "id", "tie"]
    curve = plain.mapInArrow(place, "id long, label string, dim int, x binary, place long").withColumn("tie", F.monotonically_increasing_id())
    curve = curve.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    folder = shared_folder(spark, "blocks")
    curve.select("id", "label", "dim", "x").mapInArrow(_cut(how, block_rows), _ddl(_BLOCK_FIELDS)).write.parquet(folder)
    written = spark.read.schema(_ddl(_BLOCK_FIELDS)).parquet(folder)
    blocks, chunks = _numbered(written, "block", _CHUNK, "chunk")
    tiles = written.where("size(slots) > 0").select("dim", "label", "block", "ids", "slots", "ax", "seeds").mapInArrow(_tiles(tile_rows), _ddl(_TILE_FIELDS)).checkpoint()
    tiles, groups = _numbered(tiles, "tile", _GROUP, "group")
    if not groups:
        return spark.createDataFrame([], answer)

    positives = _search(spark, tiles, groups, blocks, chunks, _ForPositives, how.positives).checkpoint()
    windows = positives.groupBy("tile").agg(F.collect_list(F.struct("slot", (F.col("rank") - 1).alias("at"), "score")).alias("windows"))
    asked = tiles.join(windows, "tile")
    negatives = _search(spark, asked, groups, blocks, chunks, _for_negatives(how), how.negatives)
    anchors = tiles.select("tile", F.posexplode("ids").alias("slot", "anchor_id"))
    known = positives.select("tile", "slot", (F.col("rank") - 1).alias("at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (negatives.join(known, ["tile", "slot", "at"]).join(anchors, ["tile", "slot"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                    F.col("positive_score").try_cast("long").alias("positive_score"), F.col("score").try_cast("long").alias("negative_score")))
