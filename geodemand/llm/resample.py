"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.llm.common import hash_words, mix64, pick, prepare, text_slices, utf8, word_bounds, word_table

_SLICE = 1 << 20
_SLOTS = 1 << 20
#: Tokens are runs of letters, digits and non-ASCII characters and, between them, runs of signs that are no blanks.
_WORD = word_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_SIGN = ~_WORD & ~word_table(bytes(range(0x21))) & ~word_table(b"\x7f")


def features(raw: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every token and pair of neighbouring tokens of the texts, case kept."""
    starts, ends, _ = word_bounds(raw, off, _WORD)
    signs, sign_ends, _ = word_bounds(raw, off, _SIGN)
    starts, ends = np.concatenate((starts, signs)), np.concatenate((ends, sign_ends))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    token = hash_words(raw, starts, ends)
    row = np.searchsorted(off, starts, side="right") - 1
    near = row[:-1] == row[1:]
    pair = mix64(token[:-1] * np.uint64(3) + token[1:])[near]
    return np.concatenate((row, row[:-1][near])), (np.concatenate((token, pair)) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of the n-grams of all ``texts`` (one string column) by bucket, summed over tasks on Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in text_slices(batches, "text", _SLICE):
            total += np.bincount(features(*utf8(batch.column(0)), buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the ratio of the two models' probabilities of each bucket; zeros without any target text."""
    if not target.sum():
        return np.zeros(len(target))
    p, q = target + smooth, raw + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def gumbel(*key: Column, seed: int) -> Column:
    """Standard Gumbel noise that a row's key and the seed decide."""
    uniform = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 4096) -> float | None:
    """Exact k-th largest value of a double column: count by bins, go on in the bin that holds it, then read the few left."""
    if k <= 0:
        return None
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return None
    k = min(k, n)
    inside = df.where(F.col(column).isNotNull())
    while low < high:
        left = inside.where(F.col(column).between(low, high))
        if n <= few:
            return sorted((r[0] for r in left.select(column).collect()), reverse=True)[k - 1]
        width = (high - low) / bins
        bin_ = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
        counts = left.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r.bin):
            if k <= r.n:
                low, high, n = r.lo, r.hi, r.n
                break
            k -= r.n
        if len(counts) == 1 and n > few and not width:
            break
    return low


def _maybe_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id falls into one of ``_SLOTS`` hash slots that ``ids`` fill, so other texts are not shuffled.

    At most ``_SLOTS`` numbers are broadcast, whatever the number of ids. Ids of another type than
    the rows' have other hashes; then all rows stay.
    """
    if rows.schema["id"].dataType != ids.schema["id"].dataType:
        return rows
    slot = F.pmod(F.xxhash64("id"), F.lit(_SLOTS)).alias("slot")
    return rows.select("*", slot).join(F.broadcast(ids.select(slot).distinct()), "slot", "left_semi").drop("slot")


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float, *, id_col: str = "doc_id", text_col: str = "text",
             buckets: int = 1 << 16, per_word: bool = False, seed: int = 11) -> DataFrame:
    """Importance weight of every row and the ``fraction`` of rows that Gumbel top-k draws.

    Two bags of hashed tokens and token pairs (``buckets`` of them, the whole model
    that the driver holds) are counted over all texts and over those whose id is
    in ``target_ids``. The log weight of a row sums the log ratio of the target's
    and the raw model's probabilities over its n-grams (with ``per_word``, their
    mean); adding Gumbel noise and keeping the k largest keys samples k rows
    without replacement in proportion to the weights. The k-th largest key is
    found by counting; rows that tie with it are all kept.

    A null or blank text has log weight 0. The noise comes from the id and the
    text, so repeated rows share a key. Null ids are no targets. Without targets
    all weights are 0. Empty tables give no rows; other columns are ignored.
    Returns id, log_weight, gumbel_key and kept.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = pick(docs, id=id_col, text=text_col)
    ids = target_ids.toDF("id").dropna().distinct().hint("shuffle_hash")
    raw = bucket_counts(rows.select("text"), buckets)
    target = bucket_counts(_maybe_in(rows, ids).join(ids, "id", "left_semi").select("text"), buckets)
    weights = spark.sparkContext.broadcast(log_ratio(target, raw))  # ``buckets`` doubles

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", _SLICE):
            of, bucket = features(*utf8(batch.column(1)), buckets)
            total = np.bincount(of, weights.value[bucket], minlength=batch.num_rows)
            if per_word:
                total /= np.maximum(np.bincount(of, minlength=batch.num_rows), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), batch.column(2)], names=["id", "log_weight", "mark"])

    kind = rows.schema["id"].dataType.simpleString()
    marked = rows.withColumn("mark", F.xxhash64("text"))
    scored = marked.mapInArrow(score, f"id {kind}, log_weight double, mark long")
    scored = scored.select("id", "log_weight", (F.col("log_weight") + gumbel(F.col("id"), F.col("mark"), seed=seed)).alias("gumbel_key")).checkpoint()
    k = int(scored.count() * fraction)
    least = kth_largest(scored, "gumbel_key", k)
    kept = F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least)
    return scored.select(F.col("id").alias(id_col), "log_weight", "gumbel_key", kept.alias("kept"))
