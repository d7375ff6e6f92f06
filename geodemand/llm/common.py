"""Helpers shared by the operators: exact-name column picks, shared folders, Arrow text buffers, word hashing."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geodemand.session import ensure_checkpoint_dir, scratch_path, ship_package


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Project ``new_name=old_name`` by exact old name.

    Spark resolves names without regard to case, so a table with both ``text``
    and ``Text`` is ambiguous; positions are not.
    """
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{names.index(old)}").alias(new) for new, old in columns.items()])


def prepare(spark: SparkSession) -> None:
    """Register the shared checkpoint folder and ship the package to the Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty.

    ``bytes[offsets[i]:offsets[i + 1]]`` is row i; the arrays are views where Arrow allows it.
    """
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def text_slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into row ranges of about ``most_bytes`` of text each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(off, off[first] + most_bytes, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def word_table(word_bytes: str | bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(word_bytes)] = True
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and the total) of the maximal runs of word bytes in each row."""
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = is_word[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_BLOCK = 1 << 20


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run, equal for equal runs wherever they stand.

    Polynomial prefix sums in blocks that begin at a word, so memory does not
    grow with the text; the length enters the final mix.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, side="right")))
        n = int(ends[j - 1]) - at
        up, down = _powers(1 << max(20, (n + 1).bit_length()))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw[at:at + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start .. start + length``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(firsts - starts, lengths)


def sizes_by_row(first: np.ndarray) -> np.ndarray:
    return np.diff(first)
