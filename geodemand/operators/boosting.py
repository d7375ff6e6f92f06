"""Boosted trees of a few leaves on bin histograms, fitted from moments that one pass over the rows collects.

For squared loss, all that a round needs of the rows is, per bin of each
feature, the sum of the residuals. That sum is the bin's sum of ``y`` less what
the scores of all other bins take away, which depends only on how many rows
each pair of bins shares. So the rows are read once: tasks count bins and pairs
of bins by fold and part, Spark adds the counts up, and every round of every
fold's model works on these moments. Their size is the square of the number of
bins, whatever the number of rows or rounds.

A round visits the features in turn. The feature's histogram is split where the
squared error falls most, twice (three leaves), each leaf with ``min_leaf``
rows; bins of a missing or unseen value are leaves of their own, and categories
are ordered by their residuals. Scores move by the learning rate times the
leaf's mean residual. Rows of the validation part only watch: the fit ends when
their loss has not fallen by ``tolerance`` of itself for ``patience`` rounds and
goes back to the best round, so no number of rounds is given.

Pairs are ranked by the best four-way cut of their residuals, found on
cumulative two-dimensional histograms, and the best few are boosted the same
way on the residuals of the main effects.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodemand.operators.additive import AdditiveModel, Binning, _coarse, best_quadrants, binned, fit_binning
from geodemand.session import ship_package

#: Numbers that a task holds at most while it counts pairs of bins; more pairs take more passes.
_CELLS = 4 << 20
_MOMENT = "kind int, slot int, cell long, n double, s double"


class Boosting(NamedTuple):
    max_bins: int = 256
    learning_rate: float = 0.01
    min_leaf: int = 2
    leaves: int = 3
    interactions: int = 3
    pair_bins: int = 16
    patience: int = 50
    tolerance: float = 1e-3
    save_every: int = 500


# ---- moments ---------------------------------------------------------------------------------

@dataclass
class Moments:
    """Sums of some rows over ``blocks`` of cells (a row has one cell in each block): rows, y, y^2, and rows by pair of cells."""

    n: float
    y: float
    yy: float
    count: np.ndarray
    total: np.ndarray
    shared: np.ndarray

    def plus(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.y + other.y, self.yy + other.yy, self.count + other.count, self.total + other.total,
                       self.shared + other.shared)


def _starts(sizes: list[int]) -> list[int]:
    return [0, *np.cumsum(sizes).tolist()]


def _count_cells(sizes: list[int], slots: int, pairs: list[tuple[int, int]], singles: bool, cells_of: Callable):
    """Task: rows and y by (block, slot, cell) and rows by (pair of blocks, slot, pair of cells)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = [np.zeros((3, slots * k)) for k in (*sizes, 1)] if singles else []
        both = [np.zeros(slots * sizes[a] * sizes[b]) for a, b in pairs]
        for batch in batches:
            for slot, cells, y in cells_of(batch):
                if singles:
                    for out, k, at in zip(alone, (*sizes, 1), (*cells, np.zeros(len(y), dtype=np.int64)), strict=True):
                        place = slot * k + at
                        for j, w in enumerate((None, y, y * y)):
                            if j < 2 or k == 1:
                                out[j] += np.bincount(place, w, out.shape[1])
                for out, (a, b) in zip(both, pairs, strict=True):
                    out += np.bincount((slot * sizes[a] + cells[a]) * sizes[b] + cells[b], minlength=len(out))
        for i, out in enumerate(alone):
            some = np.flatnonzero(out[0])
            size = (*sizes, 1)[i]
            yield _moment_rows(-1 - i, some // size, some % size, out[0][some], out[1][some])
            if size == 1 and i == len(sizes):
                yield _moment_rows(-2 - i, some, some * 0, out[0][some], out[2][some])
        for i, (out, (a, b)) in enumerate(zip(both, pairs, strict=True)):
            some = np.flatnonzero(out)
            size = sizes[a] * sizes[b]
            yield _moment_rows(a * len(sizes) + b, some // size, some % size, out[some], out[some] * 0)
    return run


def _moment_rows(kind: int, slot, cell, n, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), kind), pa.int32()), pa.array(slot, pa.int32()), pa.array(cell, pa.int64()),
                                       pa.array(n, pa.float64()), pa.array(s, pa.float64())], names=["kind", "slot", "cell", "n", "s"])


def count_moments(rows: DataFrame, sizes: list[int], slots: int, cells_of: Callable) -> DataFrame:
    """Moments as a table (kind, slot, cell, n, s); ``cells_of(batch)`` gives (slot, cells of each block, y) of its rows."""
    ship_package(rows.sparkSession)
    found, group, used = None, [], 0
    groups = []
    for pair in combinations(range(len(sizes)), 2):
        cells = slots * sizes[pair[0]] * sizes[pair[1]]
        if group and used + cells > _CELLS:
            groups.append(group)
            group, used = [], 0
        group.append(pair)
        used += cells
    for i, pairs in enumerate([*groups, group]):
        part = rows.mapInArrow(_count_cells(sizes, slots, pairs, i == 0, cells_of), _MOMENT)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("kind", "slot", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def read_moments(table: DataFrame, sizes: list[int], slots: int) -> list[Moments]:
    """The moments of each slot; the square of the number of cells each."""
    starts = _starts(sizes)
    out = [Moments(0.0, 0.0, 0.0, np.zeros(starts[-1]), np.zeros(starts[-1]), np.zeros((starts[-1], starts[-1]))) for _ in range(slots)]
    found = table.toArrow()
    kind, slot, cell, n, s = (found[c].to_numpy() for c in ("kind", "slot", "cell", "n", "s"))
    order = np.lexsort((slot, kind))
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(kind[order]) != 0) | (np.diff(slot[order]) != 0), [True]))) if len(order) else [0]
    for a, b in zip(edge, edge[1:], strict=False):
        part = order[a:b]
        k, m, at = int(kind[part[0]]), out[int(slot[part[0]])], cell[part]
        if k >= 0:
            i, j = divmod(k, len(sizes))
            x, y = starts[i] + at // sizes[j], starts[j] + at % sizes[j]
            m.shared[x, y] = m.shared[y, x] = n[part]
        elif -1 - k < len(sizes):
            at = starts[-1 - k] + at
            m.count[at], m.total[at], m.shared[at, at] = n[part], s[part], n[part]
        elif -1 - k == len(sizes):
            m.n, m.y = float(n[part][0]), float(s[part][0])
        else:
            m.yy = float(s[part][0])
    return out


# ---- rounds ----------------------------------------------------------------------------------

def best_leaves(r: np.ndarray, n: np.ndarray, leaves: int, least: float) -> list[tuple[int, int]]:
    """Ranges of neighbouring bins, best first split first, that lower the squared error most; one range if none does."""
    cr, cn = np.concatenate(([0.0], np.cumsum(r))), np.concatenate(([0.0], np.cumsum(n)))

    def cut(a: int, b: int) -> tuple[float, int]:
        left, right = cn[a + 1:b] - cn[a], cn[b] - cn[a + 1:b]
        good = (left >= least) & (right >= least)
        if not good.any():
            return 0.0, 0
        up, down = cr[a + 1:b] - cr[a], cr[b] - cr[a + 1:b]
        gain = np.where(good, up * up / np.maximum(left, 1) + down * down / np.maximum(right, 1), -np.inf)
        at = int(gain.argmax())
        return float(gain[at] - (cr[b] - cr[a]) ** 2 / max(cn[b] - cn[a], 1)), a + 1 + at

    parts = {(0, len(r)): cut(0, len(r))}
    while len(parts) < leaves:
        (a, b), (gain, at) = max(parts.items(), key=lambda p: p[1][0])
        if gain <= 0 or not at:
            break
        del parts[a, b]
        parts[a, at], parts[at, b] = cut(a, at), cut(at, b)
    return sorted(parts)


class Block(NamedTuple):
    """Cells of a term. ``ordered``: bins 1.. in order, bin 0 alone. ``free``: bins 1..-2 in any order, first and last alone. ``shape``: a pair."""

    start: int
    size: int
    kind: str
    shape: tuple[int, int] | None = None


def _leaf_cells(block: Block, r: np.ndarray, n: np.ndarray, how: Boosting) -> list[np.ndarray]:
    if block.shape:
        _, i, j = best_quadrants(r.reshape(block.shape), n.reshape(block.shape), how.min_leaf)
        if not i:
            return []
        row, column = np.divmod(np.arange(block.size), block.shape[1])
        quarter = (row >= i) * 2 + (column >= j)
        return [np.flatnonzero(quarter == q) for q in range(4)]
    alone = [np.array([0])]
    places = np.arange(1, block.size)
    if block.kind == "free":
        alone.append(places[-1:])
        places = places[:-1]
        places = places[n[places] > 0]
        places = places[np.argsort(r[places] / n[places], kind="stable")]
    return [*alone, *(places[a:b] for a, b in best_leaves(r[places], n[places], how.leaves, how.min_leaf) if b > a)]


@dataclass
class State:
    """Where a fit stands; all arrays that a round changes, so a saved state goes on to the same model."""

    score: np.ndarray
    left: np.ndarray            # residual sums of the training rows, by cell
    left_valid: np.ndarray      # of the validation rows
    loss: float                 # squared error of the validation rows
    best: np.ndarray
    best_loss: float
    round: int = 0
    best_round: int = 0
    mark: float = 0.0           # loss that counts as progress when it falls by the tolerance
    mark_round: int = 0
    done: bool = False

    def dump(self) -> bytes:
        raw = io.BytesIO()
        np.savez(raw, **vars(self))
        return raw.getvalue()

    @staticmethod
    def load(raw: bytes) -> State:
        with np.load(io.BytesIO(raw)) as z:
            return State(**{k: z[k] if z[k].ndim else z[k].item() for k in z.files})


def first_state(train: Moments, valid: Moments, intercept: float) -> State:
    zero = np.zeros(len(train.count))
    loss = valid.yy - 2 * intercept * valid.y + intercept * intercept * valid.n
    return State(zero, train.total - intercept * train.count, valid.total - intercept * valid.count, loss, zero, loss, mark=loss)


class _Shared:
    """Rows shared with the cells of each block, summed up from the block's first cell, so a leaf of neighbours costs two rows."""

    def __init__(self, moments: Moments, blocks: list[Block]):
        self.rows = moments.shared
        self.sums = {b.start: np.vstack((np.zeros(len(self.rows)), np.cumsum(self.rows[b.start:b.start + b.size], axis=0)))
                     for b in blocks if b.kind == "ordered"}

    def taken(self, block: Block, leaves: list[tuple[np.ndarray, float]]) -> np.ndarray:
        """What a step in a block takes off the residual sums of all cells."""
        if block.kind == "ordered":
            sums = self.sums[block.start]
            return sum(v * (sums[c[-1] + 1] - sums[c[0]]) for c, v in leaves)
        return sum(v * self.rows[block.start + c].sum(axis=0) for c, v in leaves)


def boost(train: Moments, valid: Moments, blocks: list[Block], how: Boosting, state: State, most: int | None = None) -> State:
    """Rounds until the validation loss settles, or ``most`` of them. Without validation rows the training loss decides."""
    watch = valid if valid.n else train
    if not valid.n and not state.round:
        state.left_valid = state.left.copy()
        state.loss = state.mark = state.best_loss = max(0.0, train.yy - train.y * train.y / train.n) if train.n else 0.0
    shared, watched = _Shared(train, blocks), _Shared(watch, blocks)
    end = None if most is None else state.round + most
    while not state.done and state.round != end:
        moved = False
        for b in blocks:
            here = slice(b.start, b.start + b.size)
            r, n = state.left[here], train.count[here]
            leaves = []
            for cells in _leaf_cells(b, r, n, how):
                rows = n[cells].sum()
                if rows >= how.min_leaf and (value := how.learning_rate * float(r[cells].sum()) / rows):
                    leaves.append((cells, value))
            if not leaves:
                continue
            moved = True
            for cells, value in leaves:
                at = b.start + cells
                state.loss += value * float(value * watch.count[at].sum() - 2 * state.left_valid[at].sum())
                state.score[at] += value
            state.left = state.left - shared.taken(b, leaves)
            state.left_valid = state.left_valid - watched.taken(b, leaves)
        state.round += 1
        if state.loss < state.best_loss:
            state.best, state.best_loss, state.best_round = state.score.copy(), state.loss, state.round
        if state.loss < state.mark * (1 - how.tolerance):
            state.mark, state.mark_round = state.loss, state.round
        state.done = not moved or state.round - state.mark_round >= how.patience
    return state


# ---- the fit ---------------------------------------------------------------------------------

@dataclass
class Fit:
    """Fitted models by fold, ``final`` on all rows; rounds of main effects and pairs; ranked pairs with their gains."""

    models: dict
    rounds: dict = field(default_factory=dict)
    gains: dict = field(default_factory=dict)


class Store:
    """What a fit has done so far, as Parquet tables under a folder; nothing is kept without one."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder = spark, folder and folder.rstrip("/")

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table written before under this name, or that of ``make``, written now."""
        if not self.folder:
            return make().checkpoint()
        path = f"{self.folder}/{name}"
        try:
            # written under a name of its own and only then named as done, so a half-written table is never read
            done = self.spark.read.parquet(f"{path}-done").first()[0]
        except AnalysisException:
            done = self.spark.sparkContext.applicationId
            made = make()
            made.write.mode("overwrite").parquet(f"{path}-{done}")
            self.spark.createDataFrame([(done,)], "by string").coalesce(1).write.mode("overwrite").parquet(f"{path}-done")
        return self.spark.read.parquet(f"{path}-{done}")

    def value(self, name: str, make: Callable[[], object]):
        return json.loads(self.table(name, lambda: self.spark.createDataFrame([(json.dumps(make()),)], "v string")).first()[0])

    def states(self, name: str) -> dict[str, State]:
        if not self.folder:
            return {}
        try:
            saved = self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return {}
        return {r.model: State.load(r.raw) for r in saved.groupBy("model").agg(F.max_by("raw", "round").alias("raw")).collect()}

    def keep(self, name: str, rows: list[tuple[str, int, bytes]]) -> None:
        if self.folder:
            saved = self.spark.createDataFrame([(m, r, bytearray(raw)) for m, r, raw in rows], "model string, round int, raw binary")
            saved.coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")


def boost_all(spark: SparkSession, name: str, fits: dict[str, tuple[Moments, Moments, list[Block]]], starts: dict[str, float], how: Boosting,
              store: Store) -> dict[str, State]:
    """The settled state of each model. Models are fitted side by side, a task each, ``save_every`` rounds at a time.

    A lost task begins its rounds anew from the state that the driver holds; a
    lost driver goes on from the states in the store.
    """
    states = store.states(name)
    for key, (train, valid, _) in fits.items():
        if key not in states:
            states[key] = first_state(train, valid, starts[key])
    shipped = {key: spark.sparkContext.broadcast(parts) for key, parts in fits.items() if not states[key].done}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                train, valid, blocks = shipped[key].value
                state = boost(train, valid, blocks, how, State.load(raw), how.save_every)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.dump()], pa.binary())], names=["model", "raw"])

    while todo := [key for key in fits if not states[key].done]:
        rows = spark.createDataFrame([(key, bytearray(states[key].dump())) for key in todo], "model string, raw binary").coalesce(1)
        found = [(r.model, bytes(r.raw)) for r in rows.repartition(len(todo)).mapInArrow(run, "model string, raw binary").collect()]
        states |= {key: State.load(raw) for key, raw in found}
        store.keep(name, [(key, states[key].round, raw) for key, raw in found])
    for b in shipped.values():
        b.unpersist()
    return states


def _slots_of(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    col = dict(zip(batch.schema.names, batch.columns, strict=True))
    return (col["fold"].to_numpy().astype(np.int64), col["part"].to_numpy().astype(np.int64),
            [col[f"b_{f}"].to_numpy().astype(np.int64) for f in names], col["y"].to_numpy().astype(float))


def _rank_pairs(models: list, features: list[str], how: Boosting):
    """Task: residual and row sums of every pair of coarse bins, for the training rows of each model."""
    pairs = list(combinations(range(len(features)), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [[m.n_coarse(features[a]) * m.n_coarse(features[b]) for a, b in pairs] for _, m in models]
        sums = [[np.zeros((2, k)) for k in row] for row in sizes]
        for batch in batches:
            fold, part, bins, y = _slots_of(batch, features)
            for (own, m), row in zip(models, sums, strict=True):
                use = (fold != own) & (part == 0)
                left = (y - m.intercept - sum(m.shapes[f][b] for f, b in zip(features, bins, strict=True)))[use]
                coarse = [_coarse(b[use], m.bins[f].n_bins, m.pair_coarse) for f, b in zip(features, bins, strict=True)]
                for out, (a, b) in zip(row, pairs, strict=True):
                    at = coarse[a] * m.n_coarse(features[b]) + coarse[b]
                    out[0] += np.bincount(at, minlength=out.shape[1])
                    out[1] += np.bincount(at, left, out.shape[1])
        for i, row in enumerate(sums):
            for k, out in enumerate(row):
                some = np.flatnonzero(out[0])
                yield _moment_rows(k, some * 0 + i, some, out[0][some], out[1][some])
    return run


def fit_boosted(rows: DataFrame, features: list[str], categorical: list[str] = (), how: Boosting = Boosting(), *,  # noqa: B008
                folds: int = 0, folder: str | None = None) -> Fit:
    """Additive models of boosted trees: one for each fold, on the rows of the others, and ``final`` on all.

    ``rows``: the features, ``y``, ``fold`` (0 .. folds - 1; absent or ignored
    without folds) and ``part`` (1 for validation rows, 0 for the others). Rows
    without y are left out. With a ``folder`` in shared storage, bins, moments and
    the state of the rounds are written there, and a call with the same folder
    goes on where another was broken off, to the same models. Rows must not change
    in between.
    """
    spark = rows.sparkSession
    store = Store(spark, folder)
    rows = rows.where(F.col("y").isNotNull())
    if "fold" not in rows.columns or not folds:
        rows = rows.withColumn("fold", F.lit(-1))
    known = store.value("bins", lambda: {f: vars(b) for f, b in fit_binning(rows, features, categorical, how.max_bins).items()})
    bins = {f: Binning(**known[f]) for f in features}
    sizes = [bins[f].n_bins for f in features]
    small = binned(rows, bins, keep=["fold", "part", "y"])
    small = store.table("rows", lambda: small.select(F.col("fold").cast("int"), F.col("part").cast("int"), F.col("y").cast("double"),
                                                     *[F.col(f"b_{f}").cast("int").alias(f"b_{f}") for f in features]))
    slots = 2 * max(1, folds)

    def cells_of(batch):
        fold, part, cells, y = _slots_of(batch, features)
        yield 2 * np.maximum(fold, 0) + part, cells, y

    moments = read_moments(store.table("moments", lambda: count_moments(small, sizes, slots, cells_of)), sizes, slots)
    starts = _starts(sizes)
    blocks = [Block(s, k, "free" if bins[f].kind == "cat" else "ordered") for f, s, k in zip(features, starts, sizes, strict=False)]
    keys = [*range(folds), "final"]

    def gathered(own, part: int) -> Moments:
        use = [moments[2 * f + part] for f in range(max(1, folds)) if f != own]
        out = use[0]
        for more in use[1:]:
            out = out.plus(more)
        return out

    models, fit = {}, Fit({})
    parts = {str(key): (gathered(key, 0), gathered(key, 1), blocks) for key in keys}
    begin = {key: (train.y / train.n if train.n else valid.y / valid.n if valid.n else 0.0) for key, (train, valid, _) in parts.items()}
    states = boost_all(spark, "main_states", parts, begin, how, store)
    for key in keys:
        state = states[str(key)]
        model = AdditiveModel(features=list(features), bins=bins, intercept=begin[str(key)], pair_coarse=how.pair_bins)
        for f, b in zip(features, blocks, strict=True):
            model.shapes[f] = state.best[b.start:b.start + b.size].copy()
        models[key], fit.rounds[key] = model, [state.best_round, 0]
        _centre(model, features, blocks, parts[str(key)][0].count)
    if how.interactions and len(features) > 1:
        _fit_pairs(small, features, models, keys, how, store, fit)
    fit.models = models
    return fit


def _centre(model: AdditiveModel, terms: list, blocks: list[Block], count: np.ndarray) -> None:
    """Every term's mean over the training rows goes into the intercept; absent bins keep their place relative to the others."""
    for t, b in zip(terms, blocks, strict=True):
        n = count[b.start:b.start + b.size]
        score = (model.pairs[t] if isinstance(t, tuple) else model.shapes[t]).reshape(-1)
        if n.sum():
            mean = float(score @ n / n.sum())
            score -= mean
            model.intercept += mean


def _fit_pairs(small: DataFrame, features: list[str], models: dict, keys: list, how: Boosting, store: Store, fit: Fit) -> None:
    pairs = list(combinations(range(len(features)), 2))
    own = [(-2 if k == "final" else k, models[k]) for k in keys]

    def ranked() -> dict:
        found = small.mapInArrow(_rank_pairs(own, features, how), _MOMENT).groupBy("kind", "slot", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        table = found.toArrow()
        kind, slot, cell, n, s = (table[c].to_numpy() for c in ("kind", "slot", "cell", "n", "s"))
        out = {}
        for i, key in enumerate(keys):
            gains = []
            for k, (a, b) in enumerate(pairs):
                shape = models[key].n_coarse(features[a]), models[key].n_coarse(features[b])
                some = (kind == k) & (slot == i)
                rows, left = np.zeros(shape), np.zeros(shape)
                rows.reshape(-1)[cell[some]], left.reshape(-1)[cell[some]] = n[some], s[some]
                gains.append((best_quadrants(left, rows, how.min_leaf)[0], a, b))
            out[str(key)] = sorted(gains, key=lambda g: (-g[0], g[1:]))
        return out

    ranks = store.value("pairs", ranked)
    chosen = {}
    for key in keys:
        fit.gains[key] = [((features[a], features[b]), g) for g, a, b in ranks[str(key)]]
        chosen[key] = [t for t, _ in fit.gains[key][:how.interactions]]
    parts = {}
    for key in keys:
        m, terms = models[key], chosen[key]
        sizes = [m.n_coarse(a) * m.n_coarse(b) for a, b in terms]
        mine = -2 if key == "final" else key

        def cells_of(batch, m=m, terms=terms, mine=mine):
            fold, part, bins, y = _slots_of(batch, features)
            use = fold != mine
            left = y - m.intercept - sum(m.shapes[f][b] for f, b in zip(features, bins, strict=True))
            coarse = {f: _coarse(b[use], m.bins[f].n_bins, m.pair_coarse) for f, b in zip(features, bins, strict=True)}
            yield part[use], [coarse[a] * m.n_coarse(b) + coarse[b] for a, b in terms], left[use]

        table = store.table(f"pair_moments_{key}", lambda sizes=sizes, cells_of=cells_of: count_moments(small, sizes, 2, cells_of))
        train, valid = read_moments(table, sizes, 2)
        parts[str(key)] = train, valid, [Block(s, k, "pair", (m.n_coarse(a), m.n_coarse(b)))
                                         for (a, b), s, k in zip(terms, _starts(sizes), sizes, strict=False)]
    states = boost_all(small.sparkSession, "pair_states", parts, dict.fromkeys(parts, 0.0), how, store)
    for key in keys:
        m, terms, state = models[key], chosen[key], states[str(key)]
        train, _, blocks = parts[str(key)]
        for (a, b), block in zip(terms, blocks, strict=True):
            m.pairs[a, b] = state.best[block.start:block.start + block.size].reshape(block.shape).copy()
        fit.rounds[key][1] = state.best_round
        _centre(m, terms, blocks, train.count)
