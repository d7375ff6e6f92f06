"""Exact interpolated quantiles without holding a column in one place.

``percentile`` keeps every distinct value of the column in one buffer, which
does not survive a 100 TB column. Here an approximate sketch
(``percentile_approx``, bounded memory) proposes a bracket for each wanted order
statistic; counting jobs then narrow every bracket to the one of its bins that
holds the statistic, until the bracket is a single value (so ties of any
number end it) or few distinct values are left. What reaches the driver is at
most ``BINS`` rows for each statistic and pass, whatever the column holds.
Statistics of several columns share the jobs. The interpolation is that of
pandas / ``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024
_SKETCH = 10_000


def _inside(d: DataFrame, brackets: dict[tuple[int, int], tuple[float, float]]) -> DataFrame:
    """(target, x) of every value in an open bracket; targets are numbered in the order of ``brackets``."""
    structs = []
    for t, ((i, _), (lo, hi)) in enumerate(brackets.items()):
        v = F.col(f"_v{i}")
        structs.append(F.struct(F.lit(t).alias("t"), F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), v).alias("x")))
    return d.select(F.explode(F.array(*structs)).alias("s")).select("s.t", "s.x").where(F.col("x").isNotNull())


def _narrow(d: DataFrame, brackets: dict[tuple[int, int], tuple[float, float]]) -> dict[int, list]:
    """Per target the non-empty bins of its bracket in order: (least, largest, count)."""
    def pick(values):
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("t") + 1)

    low = pick(lo for lo, _ in brackets.values())
    width = pick(hi / BINS - lo / BINS for lo, hi in brackets.values())
    bin_ = F.when(width > 0, F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1))).otherwise(F.lit(0))
    rows = (_inside(d, brackets).groupBy("t", bin_.alias("bin"))
            .agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).collect())
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.t, r.bin)):
        out.setdefault(r.t, []).append((r.lo, r.hi, r.n))
    return out


def order_statistics(df: DataFrame, wanted: dict[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    """The k-th smallest non-null value (from 0) of each column for each wanted k."""
    cols = list(wanted)
    d = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    todo = {(i, k): None for i, c in enumerate(cols) for k in wanted[c]}
    if not todo:
        return {c: {} for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"_v{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.percentile_approx(v, [x / 100 for x in range(101)], _SKETCH).alias(f"a{i}")]
    top = d.agg(*aggs).first()
    brackets, below = {}, {}
    for i, k in todo:
        marks, n = top[f"a{i}"], top[f"n{i}"]
        at = 100 * k / max(1, n - 1)
        brackets[i, k] = (marks[max(0, math.floor(at) - 1)], marks[min(100, math.ceil(at) + 1)])
    # what lies below each proposed bracket; one that misses its statistic starts from the whole range
    counts = d.agg(*[F.count(F.when(F.col(f"_v{i}") < F.lit(lo), 1)).alias(f"b{t}") for t, ((i, _), (lo, _)) in enumerate(brackets.items())],
                   *[F.count(F.when(F.col(f"_v{i}") <= F.lit(hi), 1)).alias(f"c{t}") for t, ((i, _), (_, hi)) in enumerate(brackets.items())]).first()
    for t, (i, k) in enumerate(list(brackets)):
        below[i, k] = counts[f"b{t}"]
        if not counts[f"b{t}"] <= k < counts[f"c{t}"]:
            brackets[i, k], below[i, k] = (top[f"lo{i}"], top[f"hi{i}"]), 0
    found: dict[tuple[int, int], float] = {}
    while brackets:
        bins = _narrow(d, brackets)
        left = {}
        for t, key in enumerate(brackets):
            for lo, hi, n in bins[t]:
                if key[1] < below[key] + n:
                    break
                below[key] += n
            if lo == hi or key[1] == below[key]:
                found[key] = lo
            elif key[1] == below[key] + n - 1:
                found[key] = hi
            else:
                left[key] = (lo, hi)
        brackets = left
    return {c: {k: found[i, k] for k in wanted[c]} for i, c in enumerate(cols)}


def exact_quantiles_multi(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """Interpolated quantiles of each column over its non-null values; None for a column without any."""
    cols = list(cols)
    counts = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    places = {c: [p * (counts[f"n{i}"] - 1) for p in probs] for i, c in enumerate(cols) if counts[f"n{i}"]}
    found = order_statistics(df, {c: sorted({k for x in xs for k in (math.floor(x), math.ceil(x))}) for c, xs in places.items()})
    out: dict[str, list] = {}
    for c in cols:
        out[c] = [None] * len(probs)
        for j, x in enumerate(places.get(c, [])):
            a, b = found[c][math.floor(x)], found[c][math.ceil(x)]
            out[c][j] = a + (b - a) * (x - math.floor(x))
    return out


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list:
    return exact_quantiles_multi(df, [col], probs)[col]
