"""Language identification: bit-sliced Bloom filters of n-grams, one bit a language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.llm.common import lower_ascii, mix64, pick, prepare, text_slices, utf8, word_table

UNKNOWN = "und"
_LETTER = word_table(bytes([*range(0x61, 0x7B), *range(0x80, 0x100)]))
_ASCII_LETTER = word_table(bytes(range(0x61, 0x7B)))
_SLICE = 1 << 20


def grams(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, first n-gram of each row and the total).

    N-grams are ``order`` bytes of the lower-cased text in which every run of
    other bytes than letters is one blank, with blanks around; each holds a letter.
    """
    raw = lower_ascii(raw)
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    edge = off[:-1][off[:-1] < off[1:]]
    keep[edge] = True
    bounds = np.concatenate(([0], np.cumsum(keep)))[off]
    flat = np.where(letter, raw, 32)[keep]
    flat = np.insert(flat, np.repeat(bounds[:-1], order), 32)
    rows = len(bounds) - 1
    flat = np.concatenate((flat, np.full(order + 1, 32, dtype=flat.dtype))).astype(np.uint8)
    bounds = bounds + order * np.arange(rows + 1)
    n = len(flat) - order - 1
    code = np.zeros(n, dtype=np.uint64)
    for j in range(order):
        code = (code << np.uint64(8)) | flat[j:n + j]
    solid = flat != 32
    good = solid[1:n + 1] | solid[:n]
    return mix64(code[good]), np.concatenate(([0], np.cumsum(good)))[bounds]


class LanguageFilter:
    """``rows[i]`` has, for each language, the bit of its Bloom filter at place i (64 languages a word)."""

    def __init__(self, languages: list[str], members: list[np.ndarray], order: int, hashes: int, spread: int):
        self.languages, self.order, self.hashes = languages, order, hashes
        most = max((len(m) for m in members), default=0)
        self.size = 1 << max(10, (most * spread - 1).bit_length())
        words = -(-max(1, len(languages)) // 64)
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.rows = [np.zeros(self.size, dtype=kind) for _ in range(words)]
        self.false_rate = np.zeros(len(languages))
        for k, gram in enumerate(members):
            word, bit = self.rows[k // 64], kind(1 << k % 64)
            for at in self.places(gram):
                word[at] |= bit
            self.false_rate[k] = (np.count_nonzero(word & bit) / self.size) ** hashes

    def places(self, gram: np.ndarray) -> Iterator[np.ndarray]:
        step = (gram >> np.uint64(32)) | np.uint64(1)
        for j in range(self.hashes):
            yield (gram + np.uint64(j) * step) & np.uint64(self.size - 1)

    def shares(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each row, share of them in each language, corrected for false positives)."""
        gram, first = grams(raw, off, self.order)
        count = np.diff(first)
        found = np.zeros((len(count), len(self.languages)))
        masks = []
        for word in self.rows:
            mask = None
            for at in self.places(gram):
                mask = word[at] if mask is None else mask & word[at]
            masks.append(mask)
        for k in range(len(self.languages)):
            hit = (masks[k // 64] >> masks[0].dtype.type(k % 64)) & masks[0].dtype.type(1)
            sums = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
            found[:, k] = np.diff(sums[first])
        share = found / np.maximum(count, 1)[:, None]
        return count, np.clip((share - self.false_rate) / (1 - self.false_rate), 0, 1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text: the language of the largest corrected share, the first of equals."""
        raw, off = utf8(texts)
        _, share = self.shares(raw, off)
        plain = np.concatenate(([0], np.cumsum(_ASCII_LETTER[lower_ascii(raw)])))
        lettered = np.diff(plain[off]) > 0
        for i in np.flatnonzero(~lettered & (np.diff(off) > 0)):
            lettered[i] = any(c.isalpha() for c in texts[int(i)].as_py())
        best = share.argmax(axis=1) if self.languages else np.zeros(len(share), dtype=int)
        score = np.where(lettered, share.max(axis=1, initial=0.0), 0.0)
        names = [self.languages[b] if ok and self.languages else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
        return names, score


def learn_languages(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
                    order: int = 5, max_docs: int = 4000, min_count: int = 3, min_rate: float = 0.25,
                    hashes: int = 3, spread: int = 12) -> LanguageFilter:
    """Bloom filters of the n-grams of each language of ``labelled``.

    Fitted on about ``max_docs`` rows a language (all, if fewer), chosen by a
    hash of ``key_col``; this documented bound also limits what the driver
    receives. A language contains an n-gram that it has ``min_count`` times and
    at ``min_rate`` or more of the rate in the language that uses it most, so
    quotations from other languages do not enter. Languages are ordered by
    their number of rows. Rows with a null text, language or key teach nothing.
    """
    spark = labelled.sparkSession
    prepare(spark)
    plain = pick(labelled, key=key_col, text=text_col, lang=lang_col).dropna()
    sizes = plain.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    languages = [r.lang for r in sorted(sizes.collect(), key=lambda r: (-r.rows, r.lang))]
    if not languages:
        return LanguageFilter([], [], order, hashes, spread)
    taken = F.pmod(F.xxhash64("key"), F.col("rows")) < max_docs
    sample = plain.join(F.broadcast(sizes), "lang").where(taken).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", _SLICE):
            names, code = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            raw, off = utf8(batch.column(1))
            gram, first = grams(raw, off, order)
            of = np.repeat(code, np.diff(first))
            for k, name in enumerate(names):
                some, n = np.unique(gram[of == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.view(np.int64)),
                                                  pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).checkpoint()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = (rates.where(F.col("n") >= min_count).join(top, "gram").where(F.col("rate") >= F.col("top") * min_rate)
            .select("lang", "gram").toArrow())
    gram = kept["gram"].to_numpy().view(np.uint64)
    lang = np.array(kept["lang"].to_pylist(), dtype=object)
    return LanguageFilter(languages, [gram[lang == name] for name in languages], order, hashes, spread)


def identify(docs: DataFrame, model: LanguageFilter, *, text_col: str = "text",
             into: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its score added, named by ``into``; the prediction sees nothing but the text.

    A null text, one without a letter, or any text when no language was learned
    is ``und`` with score 0. The score is the share of the text's n-grams that
    its language contains, corrected for false positives. All rows and other
    columns stay. No shuffle.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, names[at], _SLICE):
            lang, score = shared.value.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)],
                                             names=[*names, "lang_pred", "lang_score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = plain.mapInArrow(run, f"{fields}, lang_pred string, lang_score double")
    return out.toDF(*docs.columns, *into)


def keep_identified(docs: DataFrame, model: LanguageFilter, *, text_col: str = "text", least: float = 0.2) -> DataFrame:
    """The rows in a learned language: neither ``und`` nor with a score below ``least``. Columns stay as they are.

    With no language learned nothing can be judged and all rows stay.
    """
    if not model.languages:
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = identify(docs.toDF(*names), model, text_col=names[docs.columns.index(text_col)], into=("lang", "score"))
    return found.where((F.col("lang") != UNKNOWN) & (F.col("score") >= least)).select(*names).toDF(*docs.columns)


def held_out(doc_id: Column) -> Column:
    """Fold 1 of 3 by the CRC-32 of the id as text; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """The labelled rows that models may learn from: those not held out."""
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang")
    return rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
