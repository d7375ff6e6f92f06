"""URL filters: host and path rules, and a character language-model ratio for the URLs that no rule fits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.llm.common import lower_ascii, pick, prepare, text_slices, utf8

ORDER = 4            # bytes of context at most
_EDGE = 0xFF         # before and after a URL; no byte of UTF-8
_PIECE = 1 << 20
_SHARE = 1024        # a window with this part of all places, or more, is frequent; so there are no more than this many
_BINS = 256          # of a score's unit, for the calibration
_FURTHEST = 16


class Rule(NamedTuple):
    allow: bool
    host: str
    path: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty without a ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host`` + ``path``, and whether it allows; nulls without one. Ties: the first listed."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(reversed(rules), key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, allow = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.allow).otherwise(allow)
    return name, allow


# ---- windows ---------------------------------------------------------------------------------

def windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of every byte and of each row's end: ``ORDER`` bytes before and the byte, as a number."""
    n = len(off) - 1
    size = np.diff(off)
    at = np.arange(len(raw)) + np.repeat((ORDER + 1) * np.arange(1, n + 1) - 1, size)
    flat = np.full(len(raw) + (ORDER + 1) * n, _EDGE, dtype=np.uint8)
    flat[at] = lower_ascii(raw)
    first = off[:-1] + (ORDER + 1) * np.arange(n)
    ends = np.cumsum(size + 1)
    place = np.arange(ends[-1] if n else 0) - np.repeat(ends - size - 1, size + 1) + np.repeat(first, size + 1)
    code = np.zeros(len(place), dtype=np.int64)
    for j in range(ORDER + 1):
        code = code << 8 | flat[place + j]
    return np.repeat(np.arange(n), size + 1), code


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, row, window) in pieces of bounded size, also of one very long text; the text is column 0."""
    for batch in text_slices(batches, "text", _PIECE):
        raw, off = utf8(batch.column(0))
        if len(raw) <= 2 * _PIECE:
            yield batch, *windows(raw, off)
            continue
        for i in range(0, len(raw), _PIECE):  # a single row
            some = raw[max(0, i - ORDER):i + _PIECE]
            row, code = windows(some, np.array([0, len(some)]))
            last = i + _PIECE >= len(raw)
            part = slice(min(i, ORDER), None if last else -1)
            yield batch, row[part], code[part]


_COUNTS = ("allow", "block", "held_allow", "held_block", "scored")


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of windows by what their rows serve for (``kind``: place in ``_COUNTS``); added up in the task."""
    held = np.zeros(0, dtype=np.int64), np.zeros((0, len(_COUNTS)), dtype=np.int64)

    def batch_of(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(counts[:, j]) for j in range(len(_COUNTS)))], names=["w", *_COUNTS])

    for batch, row, code in _pieces(batches):
        kind = batch.column(1).to_numpy().astype(np.int64)[row]
        keys, at = np.unique(np.concatenate((held[0], code)), return_inverse=True)
        counts = np.zeros((len(keys), len(_COUNTS)), dtype=np.int64)
        counts[at[:len(held[0])]] = held[1]
        counts += np.bincount(at[len(held[0]):] * len(_COUNTS) + kind, minlength=counts.size).reshape(counts.shape)
        again = (kind == 2) | (kind == 3)  # held-out rows are scored, too
        counts[:, 4] += np.bincount(at[len(held[0]):][again], minlength=len(keys))
        held = keys, counts
        if len(keys) > 1 << 20:
            yield batch_of(*held)
            held = np.zeros(0, dtype=np.int64), np.zeros((0, len(_COUNTS)), dtype=np.int64)
    if len(held[0]):
        yield batch_of(*held)


# ---- the models ------------------------------------------------------------------------------

def _blend(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Witten-Bell: the share of the longer context, with as many parts of the shorter one as it has kinds of followers."""
    whole = total + kinds
    return np.where(whole > 0, (n + kinds * lower) / np.maximum(whole, 1), lower)


def low_orders(pairs: np.ndarray) -> np.ndarray:
    """Probability of a byte after one byte, for each pair of bytes, from the counts of all 65,536 pairs."""
    table = pairs.reshape(256, 256).astype(float)
    one = table.sum(axis=0)
    base = _blend(one, np.full(256, one.sum()), np.full(256, np.count_nonzero(one)), np.full(256, 1 / 256))
    return _blend(table, table.sum(axis=1, keepdims=True), np.count_nonzero(table, axis=1)[:, None], base[None, :]).ravel()


def probabilities(w: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Probability of each window's last byte after the bytes before it, from the counts ``n`` of all windows of its
    last two context bytes."""
    p = low[w & 0xFFFF]
    for order in range(2, ORDER + 1):
        gram, of_gram = np.unique(w & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        count = np.bincount(of_gram, n, len(gram))
        context, of_context = np.unique(gram >> 8, return_inverse=True)
        total = np.bincount(of_context, count, len(context))
        kinds = np.bincount(of_context, count > 0, len(context))
        p = _blend(count[of_gram], total[of_context][of_gram], kinds[of_context][of_gram], p)
    return p


def _ratios(low: dict[str, np.ndarray]):
    """Partition of whole context groups: log ratio of each window by the fold's models and by those of all labelled rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        held = pa.Table.from_batches(parts)
        w = held["w"].to_numpy()
        n = {c: held[c].to_numpy() for c in _COUNTS}
        fold = np.log(probabilities(w, n["allow"], low["allow"])) - np.log(probabilities(w, n["block"], low["block"]))
        whole = (np.log(probabilities(w, n["allow"] + n["held_allow"], low["all_allow"]))
                 - np.log(probabilities(w, n["block"] + n["held_block"], low["all_block"])))
        some = n["scored"] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (w, fold, whole, n["scored"])], names=["w", "fold", "whole", "n"])
    return run


def _places(frequent: dict[int, tuple[float, float]]):
    """Places to look up: (row, window); what frequent windows add is summed here and has a null window."""
    keys = np.array(sorted(frequent), dtype=np.int64)
    value = np.array([frequent[k] for k in keys.tolist()]).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, code in _pieces(batches):
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            rid = batch.column(2).to_numpy()
            at = np.minimum(np.searchsorted(keys, code), max(0, len(keys) - 1))
            known = keys[at] == code if len(keys) else np.zeros(len(code), dtype=bool)
            part = value[at[known], np.where(held[row[known]], 0, 1)] if len(keys) else np.zeros(0)
            sums = np.bincount(row[known], part, batch.num_rows)
            rest = row[~known]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((rid, rid[rest]))), pa.array(np.concatenate((held, held[rest]))),
                 pa.array(np.concatenate((np.zeros(len(rid), np.int64), code[~known])), mask=np.arange(len(rid) + len(rest)) < len(rid)),
                 pa.array(np.concatenate((sums, np.zeros(len(rest)))))], names=["rid", "held", "w", "known"])
    return run


def calibrate(bins: np.ndarray, allow: np.ndarray, block: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from a score to the chance of ``allow``, both classes of equal weight.

    A ridge of one row towards slope 1 and offset 0, which are returned as they
    are where a class has no rows or the slope would not rise.
    """
    total = allow.sum(), block.sum()
    if not min(total):
        return 1.0, 0.0
    middle = (bins + 0.5) / _BINS
    x = np.concatenate((middle, middle))
    y = np.repeat([1.0, 0.0], len(bins))
    weight = np.concatenate((allow / total[0], block / total[1])) * (total[0] + total[1]) / 2
    point = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(point[0] * x + point[1], -60, 60)))
        slope = np.array([(weight * (p - y) * x).sum() + point[0] - 1, (weight * (p - y)).sum() + point[1]])
        v = weight * p * (1 - p)
        bend = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 4 / np.abs(step).max()) if np.abs(step).max() else 1.0
        point = point - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(point[0]), float(point[1])) if point[0] > 0 else (1.0, 0.0)


def judge_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", least: float = 0.5) -> DataFrame:
    """Verdict of every row's URL: ``allow`` or ``block`` by the longest rule that fits, else by the models.

    All rows that a rule fits are examples, accepted or rejected. Two Markov
    models of variable order (up to four bytes of context, Witten-Bell smoothing
    down to uniform bytes; text lower-cased, after ``://`` where there is one)
    count all of them. A URL's score is the difference of its log-likelihoods
    divided by its length, the end counted. A third of the examples, by the
    URL's hash, calibrates: models of the other two thirds score it, and a
    logistic curve with equal weight of both classes maps scores to the chance
    of ``allow``; ``least`` or more allows.

    Counts grow with the corpus and stay distributed: windows are counted in the
    tasks, then by key, and ratios are computed where all windows of two context
    bytes meet (at most 2^24). Windows that take 1/1,024 of all places or more
    are added up where the URL is read, the others are joined.

    A null URL, or one that the models never tell apart, scores 0. Without
    examples of both classes all scores are 0 and the verdict is ``allow``. All
    rows are kept, repeated ones too; other columns are ignored; empty tables
    give no rows. Returns id, host, path, rule (null without one), verdict, and
    score and chance (null where a rule decides).
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pick(pages, id=id_col, url=url_col)
    host, path = url_parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("rid", F.monotonically_increasing_id())
    rule, allow = fitting_rule(F.col("host"), F.col("path"), rules)
    at = F.instr("url", "://")
    text = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise(F.col("url"))
    rows = rows.select("id", "rid", "host", "path", rule.alias("rule"), allow.alias("allow"), F.coalesce(text, F.lit("")).alias("text"),
                       (F.pmod(F.xxhash64("url"), F.lit(3)) == 0).alias("held")).checkpoint()
    kind = F.when(F.col("allow").isNull(), 4).otherwise(F.when(F.col("allow"), 0).otherwise(1) + F.when(F.col("held"), 2).otherwise(0))
    counted = rows.select("text", kind.cast("int").alias("kind")).mapInArrow(_count_windows, "w long, " + ", ".join(f"{c} long" for c in _COUNTS))
    counted = counted.groupBy("w").agg(*[F.sum(c).alias(c) for c in _COUNTS]).checkpoint()

    pairs = counted.groupBy(F.col("w").bitwiseAND(0xFFFF).cast("int").alias("pair")).agg(*[F.sum(c).alias(c) for c in _COUNTS]).collect()
    table = {c: np.zeros(1 << 16) for c in _COUNTS}
    for r in pairs:  # at most 65,536
        for c in _COUNTS:
            table[c][r.pair] = r[c]
    table["all_allow"], table["all_block"] = table["allow"] + table["held_allow"], table["block"] + table["held_block"]
    total = float(table["scored"].sum())
    scored = None
    if min(table["all_allow"].sum(), table["all_block"].sum()) and total:
        low = {c: low_orders(table[c]) for c in ("allow", "block", "all_allow", "all_block")}
        context = F.shiftright("w", 8).bitwiseAND(0xFFFF)
        ratios = counted.repartition(context).mapInArrow(_ratios(low), "w long, fold double, whole double, n long").checkpoint()
        frequent = {r.w: (r.fold, r.whole) for r in ratios.where(F.col("n") * _SHARE >= total).collect()}
        places = rows.where("rule is null or held").select("text", (F.col("held") & F.col("rule").isNotNull()).alias("held"), "rid")
        places = places.mapInArrow(_places(frequent), "rid long, held boolean, w long, known double").join(ratios, "w", "left")
        each = F.when(F.col("w").isNull(), F.col("known")).when(F.col("held"), F.col("fold")).otherwise(F.col("whole"))
        scored = places.groupBy("rid").agg(F.sum(each).alias("sum"))
    if scored is None:
        scored = rows.select("rid", F.lit(0.0).alias("sum"))
    size = F.octet_length("text") + 1
    judged = rows.where("rule is null or held").join(scored, "rid").withColumn("score", F.col("sum") / size)
    judged = judged.select("id", "host", "path", "rule", "allow", "score").checkpoint()
    bins = F.greatest(F.lit(-_FURTHEST * _BINS), F.least(F.lit(_FURTHEST * _BINS), F.floor(F.col("score") * _BINS)))
    seen = judged.where("rule is not null").groupBy(bins.alias("bin")).agg(
        F.count_if("allow").alias("allow"), F.count_if(~F.col("allow")).alias("block")).collect()  # at most 8,193 bins
    slope, offset = calibrate(*(np.array([r[c] for r in seen], dtype=float) for c in ("bin", "allow", "block")))
    chance = 1 / (1 + F.exp(-(F.col("score") * slope + offset)))
    verdict = lambda allow: F.when(allow, "allow").otherwise("block")
    model = judged.where("rule is null").select("id", "host", "path", "rule", "score", chance.alias("chance"))
    model = model.select("id", "host", "path", "rule", verdict(F.col("chance") >= least).alias("verdict"), "score", "chance")
    ruled = rows.where("rule is not null").select("id", "host", "path", "rule", verdict(F.col("allow")).alias("verdict"),
                                                  F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("chance"))
    return ruled.unionByName(model).withColumnRenamed("id", id_col)
