"""Interpretable additive boosted regression (main effects + a few pairwise terms) on DataFrame aggregates.

Design for scale
* Bin once. Numeric features get equal-frequency edges from
  ``percentile_approx`` (or equal-width edges); bin 0 holds NULL, an extra
  last bin of a categorical feature holds categories unseen in training
  (its score stays 0).
* Compress once. Rows with the same bin vector (and fold) collapse into one
  row with ``n`` and ``sum_y``; for squared loss that is all a fit needs. The
  compressed table is checkpointed (lineage cut, survives executor loss).
* One Spark job per round updates every term: each task adds its rows up in one
  histogram per term (Arrow batches, ``bincount``) and the histograms are summed,
  so no row is exploded. The model state -- at most terms x bins doubles -- lives
  on the driver and travels with the next round.
* Scoring is a pure column expression (``element_at`` on literal arrays),
  inside whole-stage codegen; no Python on the scoring path.
Updates are simultaneous (Jacobi-style) with the learning rate as damping;
each shape is re-centred (count-weighted) into the intercept after a round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geodemand.session import ship_package


@dataclass
class Binning:
    kind: str                      # "num" | "cat"
    edges: list[float] = field(default_factory=list)   # numeric interior cut points, ascending
    cats: list[str] = field(default_factory=list)      # categorical values, ascending

    @property
    def n_bins(self) -> int:
        """Bins including the NULL bin 0 (and the unseen bin for categories)."""
        return len(self.edges) + 2 if self.kind == "num" else len(self.cats) + 2

    def expr(self, col: str) -> Column:
        c = F.col(col)
        if self.kind == "num":
            if not self.edges:
                return F.when(c.isNull(), 0).otherwise(1)
            edges = F.array(*[F.lit(float(e)) for e in self.edges])
            return F.when(c.isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e < c.cast("double"))) + 1)
        cats = F.array(*[F.lit(v) for v in self.cats])
        pos = F.array_position(cats, c.cast("string")).cast("int")
        return F.when(c.isNull(), 0).when(pos == 0, len(self.cats) + 1).otherwise(pos)

    def intervals(self) -> list[tuple[float | None, float | None]]:
        if self.kind != "num":
            return [(None, None)] * self.n_bins
        pts = [-math.inf] + list(self.edges) + [math.inf]
        return [(None, None)] + [(pts[i], pts[i + 1]) for i in range(len(pts) - 1)]


def fit_binning(df: DataFrame, features: list[str], categorical: list[str] = (), max_bins: int = 32,
                method: str = "quantile", accuracy: int = 10000) -> dict[str, Binning]:
    """Bin edges for every feature from one aggregation job (quantile edges are approximate by design)."""
    aggs = []
    for f in features:
        if f in categorical:
            aggs.append(F.array_sort(F.collect_set(F.col(f).cast("string"))).alias(f))
        elif method == "quantile":
            probs = [i / max_bins for i in range(1, max_bins)]
            aggs.append(F.percentile_approx(F.col(f).cast("double"), probs, accuracy).alias(f))
        else:
            aggs.append(F.array(F.min(F.col(f).cast("double")), F.max(F.col(f).cast("double"))).alias(f))
    row = df.agg(*aggs).first()
    out = {}
    for f in features:
        v = row[f]
        if f in categorical:
            out[f] = Binning("cat", cats=list(v or []))
        elif method == "quantile":
            out[f] = Binning("num", edges=sorted({float(x) for x in (v or []) if x is not None}))
        else:
            lo, hi = v if v is not None else (None, None)
            if lo is None or hi is None or not hi > lo:
                out[f] = Binning("num", edges=[])
            else:
                out[f] = Binning("num", edges=[lo + (hi - lo) * i / max_bins for i in range(1, max_bins)])
    return out


def binned(df: DataFrame, bins: dict[str, Binning], keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, *[bins[f].expr(f).alias(f"b_{f}") for f in bins])


def compress(df_binned: DataFrame, features: list[str], y: str = "y", extra_keys: list[str] = ()) -> DataFrame:
    """Collapse rows with identical bin vectors: n, sum_y."""
    keys = [*extra_keys, *[f"b_{f}" for f in features]]
    return df_binned.where(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sum_y"), F.sum(F.col(y) * F.col(y)).alias("sum_y2"))


def _const_sql(values) -> str:
    """An array<double> literal as SQL (folded by the optimizer into one Literal held by reference)."""
    return "from_json('[" + ",".join(repr(float(v)) for v in values) + "]', 'array<double>')"


@dataclass
class AdditiveModel:
    features: list[str]
    bins: dict[str, Binning]
    intercept: float = 0.0
    shapes: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    pair_coarse: int = 8
    history: list[float] = field(default_factory=list)   # training MSE before each round

    # -- expressions --------------------------------------------------------------------
    def coarse_sql(self, f: str) -> str:
        nb = self.bins[f].n_bins
        if nb <= self.pair_coarse:
            return f"b_{f}"
        return f"(CASE WHEN b_{f} = 0 THEN 0 ELSE CAST(CEIL(b_{f} * {self.pair_coarse - 1} / {nb - 1}) AS INT) END)"

    def coarse(self, f: str) -> Column:
        return F.expr(self.coarse_sql(f))

    def n_coarse(self, f: str) -> int:
        return min(self.bins[f].n_bins, self.pair_coarse)

    def score_sql(self) -> str:
        """Prediction from b_<feature> columns as SQL text.

        Model values enter as array literals (constant-folded), so the generated
        code is identical from round to round and is compiled once; the whole
        expression crosses to the JVM as one string.
        """
        parts = [f"element_at({_const_sql([self.intercept])}, 1)"]
        for f in self.features:
            parts.append(f"element_at({_const_sql(self.shapes[f])}, b_{f} + 1)")
        for (a, b), m in self.pairs.items():
            cell = f"{self.coarse_sql(a)} * {self.n_coarse(b)} + {self.coarse_sql(b)} + 1"
            parts.append(f"element_at({_const_sql(m.ravel())}, {cell})")
        return " + ".join(parts)

    def score_binned(self) -> Column:
        return F.expr(self.score_sql())

    def score(self, df: DataFrame, out: str = "pred_log") -> DataFrame:
        """Score raw feature columns (missing feature columns count as NULL)."""
        d = df
        for f in self.features:
            if f not in d.columns:
                d = d.withColumn(f, F.lit(None).cast("string" if self.bins[f].kind == "cat" else "double"))
        d = d.withColumns({f"b_{f}": self.bins[f].expr(f) for f in self.features})
        return d.withColumn(out, self.score_binned()).drop(*[f"b_{f}" for f in self.features])

    # -- exports ------------------------------------------------------------------------
    def shape_rows(self) -> list[tuple]:
        rows = []
        for f in self.features:
            for i, ((lo, hi), s) in enumerate(zip(self.bins[f].intervals(), self.shapes[f])):
                cat = None
                if self.bins[f].kind == "cat" and 1 <= i <= len(self.bins[f].cats):
                    cat = self.bins[f].cats[i - 1]
                rows.append((f, i, None if lo is None or math.isinf(lo) else float(lo),
                             None if hi is None or math.isinf(hi) else float(hi), cat, float(s)))
        return rows

    def shape_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.shape_rows(),
                                     "feature string, bin int, x_lo double, x_hi double, category string, score double")


def _coarse(bins: np.ndarray, n_bins: int, most: int) -> np.ndarray:
    """Array twin of :meth:`AdditiveModel.coarse_sql`."""
    if n_bins <= most:
        return bins
    return np.where(bins == 0, 0, -(-bins * (most - 1) // (n_bins - 1)))


def _histograms(batches: Iterator[pa.RecordBatch], features: list[str], models: list, terms: list[list]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition per (model, term, cell): residuals, rows and, with the first term, squared errors."""
    def cells(model, t):
        return model.pairs[t].size if isinstance(t, tuple) else model.shapes[t].size

    sums = {(i, k): np.zeros((3, cells(m, t))) for i, m in enumerate(models) for k, t in enumerate(terms[i])}
    for batch in batches:
        col = dict(zip(batch.schema.names, batch.columns))
        bin_of = {f: col[f"b_{f}"].to_numpy() for f in features}
        n, y, y2 = (col[c].to_numpy().astype(float) for c in ("n", "sum_y", "sum_y2"))
        for i, m in enumerate(models):
            coarse = {f: _coarse(b, m.bins[f].n_bins, m.pair_coarse) for f, b in bin_of.items()}
            at = {t: coarse[t[0]] * m.n_coarse(t[1]) + coarse[t[1]] for t in {*m.pairs, *(t for t in terms[i] if isinstance(t, tuple))}}
            p = m.intercept + sum(m.shapes[f][b] for f, b in bin_of.items()) + sum(v.ravel()[at[t]] for t, v in m.pairs.items())
            used = col[f"_k{i}"].to_numpy(zero_copy_only=False)
            weights = np.where(used, y - n * p, 0.0), np.where(used, n, 0.0), np.where(used, y2 - 2.0 * p * y + n * p * p, 0.0)
            for k, t in enumerate(terms[i]):
                cell = at[t] if isinstance(t, tuple) else bin_of[t]
                for j, w in enumerate(weights if k == 0 else weights[:2]):
                    sums[i, k][j] += np.bincount(cell, w, minlength=sums[i, k].shape[1])
    for (i, k), (r, n, q) in sums.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), i), pa.int32()), pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()),
             pa.array(r[some]), pa.array(n[some]), pa.array(q[some])], names=["m", "t", "bin", "r", "n", "q"])


def _round_sums_many(comp: DataFrame, models: list, masks: list[str], terms: list[list]) -> list[dict]:
    """ONE aggregation job for several models at once (e.g. every CV fold plus the final fit).

    Each task sums its rows into one histogram per (model, term), for the models
    whose training mask a row satisfies; the histograms are added up on Spark. A
    round moves models x terms x bins numbers a task, however many rows there are.
    """
    ship_package(comp.sparkSession)
    features = models[0].features
    plain = comp.select(*[F.col(f"b_{f}").cast("int").alias(f"b_{f}") for f in features], F.col("n").cast("double").alias("n"),
                        "sum_y", "sum_y2", *[F.expr(m).alias(f"_k{i}") for i, m in enumerate(masks)])
    found = plain.mapInArrow(lambda b: _histograms(b, features, models, terms), "m int, t int, bin int, r double, n double, q double")
    rows = found.groupBy("m", "t", "bin").agg(F.sum("r").alias("r"), F.sum("n").alias("n"), F.sum("q").alias("q")).collect()
    out = [{"_sse": 0.0} for _ in models]
    for row in rows:
        d = out[row["m"]]
        d[(row["t"], row["bin"])] = (row["r"], row["n"])
        d["_sse"] += row["q"]
    return out


def fit_additive_many(comp: DataFrame, features: list[str], bins: dict[str, Binning], masks: dict,
                      rounds: int = 60, learning_rate: float = 0.1, min_leaf: int = 2, interactions: int = 0,
                      interaction_rounds: int | None = None, pair_coarse: int = 8, tolerance: float = 0.0) -> dict:
    """Fit one model per training mask (SQL predicate over the compressed table) in lock-step.

    ``rounds`` is the most; with a ``tolerance`` the main effects stop once a round
    lowers no model's training error by more than that share of it.

    Every boosting round of every model is served by the same single
    aggregation job, so k-fold cross-validation plus the final fit costs one
    job per round instead of k + 1.
    """
    keys = list(masks)
    mask_sql = [masks[k] for k in keys]
    tots = comp.agg(*[F.sum(F.expr(f"CASE WHEN {m} THEN n END")).alias(f"n{i}") for i, m in enumerate(mask_sql)],
                    *[F.sum(F.expr(f"CASE WHEN {m} THEN sum_y END")).alias(f"s{i}")
                      for i, m in enumerate(mask_sql)]).first()
    models = []
    for i, _ in enumerate(keys):
        m = AdditiveModel(features=list(features), bins=bins, intercept=float(tots[f"s{i}"] / tots[f"n{i}"]),
                          pair_coarse=pair_coarse)
        for f in features:
            m.shapes[f] = np.zeros(bins[f].n_bins)
        models.append(m)

    def step(term_lists):
        sums = _round_sums_many(comp, models, mask_sql, term_lists)
        for i, m in enumerate(models):
            s = sums[i]
            m.history.append(s.pop("_sse") / tots[f"n{i}"])
            for t_idx, t in enumerate(term_lists[i]):
                arr = m.pairs[t] if isinstance(t, tuple) else m.shapes[t]
                flat = arr.reshape(-1)
                wsum = 0.0
                ntot = 0.0
                for cell in range(flat.size):
                    r, n = s.get((t_idx, cell), (0.0, 0))
                    if n >= min_leaf:
                        flat[cell] += learning_rate * r / n
                    wsum += flat[cell] * n
                    ntot += n
                if ntot > 0:
                    mean = wsum / ntot
                    flat -= mean
                    m.intercept += mean

    for _ in range(rounds):
        step([list(features)] * len(models))
        if tolerance and all(len(m.history) > 1 and m.history[-2] - m.history[-1] <= tolerance * m.history[-2] for m in models):
            break
    if interactions > 0:
        for i, m in enumerate(models):
            gains = pair_gains(comp.where(mask_sql[i]), m)
            for (a, b), _g in gains[:interactions]:
                m.pairs[(a, b)] = np.zeros((m.n_coarse(a), m.n_coarse(b)))
        for _ in range(interaction_rounds if interaction_rounds is not None else rounds):
            step([list(m.pairs) for m in models])
    return dict(zip(keys, models))


def fit_additive(comp: DataFrame, features: list[str], bins: dict[str, Binning], rounds: int = 60,
                 learning_rate: float = 0.1, min_leaf: int = 2, interactions: int = 0,
                 interaction_rounds: int | None = None, pair_coarse: int = 8, tolerance: float = 0.0) -> AdditiveModel:
    """Fit on a compressed table (b_<f> columns, n, sum_y, sum_y2). One Spark job per round."""
    return fit_additive_many(comp, features, bins, {"all": "true"}, rounds=rounds, learning_rate=learning_rate,
                             min_leaf=min_leaf, interactions=interactions, interaction_rounds=interaction_rounds,
                             pair_coarse=pair_coarse, tolerance=tolerance)["all"]


def best_quadrants(r: np.ndarray, n: np.ndarray, least: float) -> tuple[float, int, int]:
    """(gain, row cut, column cut) of the best four-way cut of two-dimensional histograms; every non-empty quarter holds ``least`` rows.

    Quarter sums come from cumulative histograms. No cut: (0, 0, 0).
    """
    def quarters(x):
        c = np.cumsum(np.cumsum(x, axis=0), axis=1)
        a, top, left, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return np.stack(np.broadcast_arrays(a, top - a, left - a, all_ - top - left + a))

    if min(r.shape) < 2:
        return 0.0, 0, 0
    qr, qn = quarters(r), quarters(n)
    qn = np.rint(qn)
    whole = r.sum() ** 2 / max(n.sum(), 1)
    gain = np.where(qn > 0, qr * qr / np.maximum(qn, 1), 0.0).sum(axis=0) - whole
    gain = np.where(((qn == 0) | (qn >= least)).all(axis=0), gain, -np.inf)
    at = int(gain.argmax())
    i, j = divmod(at, gain.shape[1])
    return (float(gain[i, j]), i + 1, j + 1) if gain[i, j] > 0 else (0.0, 0, 0)


def pair_gains(comp: DataFrame, model: AdditiveModel, min_leaf: int = 2) -> list[tuple[tuple[str, str], float]]:
    """Feature pairs by the squared error that the best four-way cut of the current residuals takes off, best first.

    One scan: tasks add the rows up in a two-dimensional histogram per pair.
    """
    pairs = [(a, b) for i, a in enumerate(model.features) for b in model.features[i + 1:]]
    if not pairs:
        return []
    blank = {(a, b): np.zeros((model.n_coarse(a), model.n_coarse(b))) for a, b in pairs}
    watch = AdditiveModel(model.features, model.bins, model.intercept, model.shapes, {**blank, **model.pairs}, model.pair_coarse)
    found = _round_sums_many(comp, [watch], ["true"], [pairs])[0]
    left, rows = ({p: np.zeros_like(b) for p, b in blank.items()} for _ in range(2))
    for key, value in found.items():
        if key != "_sse":
            t, cell = key
            left[pairs[t]].reshape(-1)[cell], rows[pairs[t]].reshape(-1)[cell] = value
    return sorted(((p, best_quadrants(left[p], rows[p], min_leaf)[0]) for p in pairs), key=lambda g: (-g[1], g[0]))


def feature_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns in the model's fixed order; features absent from ``df`` are silently left out."""
    return df.select(*[f for f in features if f in df.columns])


def save_model(model: AdditiveModel, spark: SparkSession, path: str) -> None:
    """Persist as two small Parquet tables: the shape table and the model metadata (binning, intercept, pairs)."""
    import json
    model.shape_table(spark).write.mode("overwrite").parquet(f"{path.rstrip('/')}/shapes")
    meta = {"features": model.features, "intercept": model.intercept, "pair_coarse": model.pair_coarse,
            "bins": {f: {"kind": b.kind, "edges": b.edges, "cats": b.cats} for f, b in model.bins.items()},
            "pairs": [[a, b, m.tolist()] for (a, b), m in model.pairs.items()]}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(
        f"{path.rstrip('/')}/meta")


def load_model(spark: SparkSession, path: str) -> AdditiveModel:
    import json
    meta = json.loads(spark.read.parquet(f"{path.rstrip('/')}/meta").first()["meta"])
    bins = {f: Binning(b["kind"], edges=b["edges"], cats=b["cats"]) for f, b in meta["bins"].items()}
    model = AdditiveModel(features=meta["features"], bins=bins, intercept=meta["intercept"],
                          pair_coarse=meta["pair_coarse"])
    rows = spark.read.parquet(f"{path.rstrip('/')}/shapes").select("feature", "bin", "score").collect()
    for f in model.features:
        model.shapes[f] = np.zeros(bins[f].n_bins)
    for r in rows:
        model.shapes[r["feature"]][r["bin"]] = r["score"]
    for a, b, m in meta["pairs"]:
        model.pairs[(a, b)] = np.array(m)
    return model


def importance(model: AdditiveModel) -> list[tuple[str, float, float, int]]:
    """Per main-effect feature: unweighted mean |score| over bins, score range, number of bins."""
    out = []
    for f in model.features:
        s = model.shapes[f]
        out.append((f, float(np.mean(np.abs(s))), float(np.max(s) - np.min(s)), int(s.size)))
    return sorted(out, key=lambda r: -r[1])


# ---- grouped, stratified folds ---------------------------------------------------------------

def quantile_strata(df: DataFrame, y: str, q: int = 5, exact: bool = True) -> tuple[DataFrame, list[float]]:
    """Equal-frequency strata of ``y`` (right-closed, lowest included, duplicate edges dropped).

    ``exact`` gives the interpolated quantiles of a pandas qcut (sketch-bracketed,
    see ``operators/quantiles.py``); otherwise ``percentile_approx`` edges.
    """
    probs = [i / q for i in range(q + 1)]
    if exact:
        from geodemand.operators.quantiles import exact_quantiles
        edges = exact_quantiles(df, y, probs)
    else:
        edges = df.agg(F.percentile_approx(F.col(y), probs, 100000).alias("e")).first()["e"]
    edges = sorted(set(float(e) for e in edges))
    interior = edges[1:-1]
    expr = F.lit(0)
    for e in interior:
        expr = expr + F.when(F.col(y) > F.lit(e), 1).otherwise(0)
    return df.withColumn("stratum", F.when(F.col(y).isNotNull(), expr)), edges


def assign_group_folds(counts: dict, n_folds: int = 5) -> dict:
    """Greedy stratified group k-fold over a group x stratum count table (bounded by #groups).

    Groups in order of descending std of their stratum counts; each goes to
    the fold that minimises the mean over strata of the std across folds of
    (fold count / stratum total); ties go to the fold with fewer rows.
    """
    strata = sorted({s for g in counts.values() for s in g})
    totals = np.array([sum(g.get(s, 0) for g in counts.values()) for s in strata], dtype=float)
    vecs = {g: np.array([c.get(s, 0) for s in strata], dtype=float) for g, c in counts.items()}
    order = sorted(vecs, key=lambda g: (-float(np.std(vecs[g])), str(g)))
    fold_counts = np.zeros((n_folds, len(strata)))
    out = {}
    for g in order:
        best, best_key = None, None
        for f in range(n_folds):
            fold_counts[f] += vecs[g]
            score = float(np.mean(np.std(fold_counts / np.where(totals > 0, totals, 1), axis=0)))
            fold_counts[f] -= vecs[g]
            key = (score, fold_counts[f].sum(), f)
            if best_key is None or key < best_key:
                best, best_key = f, key
        fold_counts[best] += vecs[g]
        out[g] = best
    return out
