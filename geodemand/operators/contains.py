"""Substring-containment theta join by an automaton of the patterns.

All patterns of a block go into one Aho-Corasick automaton, which a task runs
over its titles once: each title is read one time a block, whatever the number
of patterns, and only true matches leave the task. Blocks hold a bounded
number of patterns, so neither the driver nor a task holds them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERNS_A_BLOCK = 50_000


def _find(patterns: list[str], at: int):
    """Task: the rows whose text (column ``at``) holds a pattern, once a pattern, with that pattern as the last column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                found = {p for _, p in automaton.iter(text)} if text else ()
                rows += [i] * len(found)
                hits += found
            if rows:
                out = batch.take(pa.array(np.array(rows)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(hits, pa.string())], names=[*out.schema.names, "_hit"])
    return run


def contains_first(patterns: DataFrame, titles: DataFrame, *, pattern: str, title: str, title_key: str, title_order: str,
                   extra: Column | None = None, per_block: int = PATTERNS_A_BLOCK) -> DataFrame:
    """For each distinct row of ``patterns``, the first title (by ``title_order``, then key) that contains its ``pattern``.

    An empty or NULL pattern matches nothing, nor does a NULL title. ``extra`` is an
    optional predicate over pattern and title columns (e.g. a state-code test).
    Returns the pattern columns plus ``title_key`` for patterns with a match.
    """
    columns = patterns.columns
    rows = patterns.distinct().where(F.length(pattern) > 0).checkpoint()
    texts = rows.select(pattern).distinct()
    blocks = max(1, math.ceil(texts.count() / per_block))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in titles.schema.fields) + ", _hit string"
    hits = None
    for b in range(blocks):
        block = [r[0] for r in texts.where(F.pmod(F.xxhash64(pattern), F.lit(blocks)) == b).collect()]  # about ``per_block``
        if block:
            part = titles.mapInArrow(_find(block, titles.columns.index(title)), fields)
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return rows.withColumn(title_key, F.lit(None).cast(titles.schema[title_key].dataType))  # no rows either
    met = hits.join(rows, F.col("_hit") == rows[pattern])
    if extra is not None:
        met = met.where(extra)
    best = F.min_by(F.col(title_key), F.struct(F.col(title_order), F.col(title_key)))
    return met.groupBy(*columns).agg(best.alias(title_key))
