"""Benchmark decontamination: an FM-index per shard of training texts, searched for benchmark windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodemand.llm.common import hash_words, lower_ascii, pick, prepare, ragged, text_slices, utf8, word_bounds, word_table
from geodemand.llm.fm_index import FMIndex

#: Word bytes after lower-casing: digits, a-z and every byte of a non-ASCII character.
WORD = word_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


class Phrases:
    """Windows of the benchmark items as symbols of the vocabulary of those windows.

    ``items`` are (id, text) pairs. Equal windows are searched once;
    ``owners[owner_first[w]:owner_first[w + 1]]`` are the items of window w.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.item_ids = [i for i, _ in items]
        raw, off = utf8(pa.array([t for _, t in items], pa.string()))
        raw = lower_ascii(raw)
        starts, ends, first = word_bounds(raw, off, WORD)
        self.hashes, at, symbol = np.unique(hash_words(raw, starts, ends), return_index=True, return_inverse=True)
        lengths = (ends - starts)[at]
        self.word_bytes = raw[ragged(starts[at], lengths)]
        self.word_first = np.concatenate(([0], np.cumsum(lengths)))
        symbol = symbol + 1
        known: dict[bytes, int] = {}
        owners: list[set[int]] = []
        for k in range(len(items)):
            words = symbol[first[k]:first[k + 1]]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                w = known.setdefault(words[i:i + size].astype(np.int32).tobytes(), len(known))
                if w == len(owners):
                    owners.append(set())
                owners[w].add(k)
        self.lengths = np.array([len(w) // 4 for w in known], dtype=np.int64)
        self.symbols = np.zeros((len(known), window), dtype=np.int64)
        for k, w in enumerate(known):
            self.symbols[k, :len(w) // 4] = np.frombuffer(w, np.int32)
        sizes = [len(o) for o in owners]
        self.owner_first = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.owners = np.array([i for o in owners for i in sorted(o)], dtype=np.int64)

    @property
    def top(self) -> int:
        return len(self.hashes)

    def to_symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words that no window has."""
        if not self.top:
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.top - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)

    def same_bytes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Whether each word has the very bytes of its symbol."""
        size = ends - starts
        vocab, want = self.word_first[symbol - 1], np.diff(self.word_first)[symbol - 1]
        same = size == want
        which = np.flatnonzero(same)
        if len(which):
            equal = raw[ragged(starts[which], size[which])] == self.word_bytes[ragged(vocab[which], size[which])]
            same[which] = np.logical_and.reduceat(equal, np.cumsum(size[which]) - size[which])
        return same


def search_shard(raw: np.ndarray, off: np.ndarray, phrases: Phrases, sample: int):
    """(words of each row, row / first word / end word of each merged span, row and item of each hit).

    The index covers every word of the shard; words outside the benchmark's
    vocabulary can be in no occurrence, so a run of them, like the end of a row,
    is one break symbol.
    """
    raw = lower_ascii(raw)
    starts, ends, first = word_bounds(raw, off, WORD)
    symbol = phrases.to_symbols(hash_words(raw, starts, ends))
    n, rows = len(symbol), len(off) - 1
    nothing = np.zeros(0, dtype=np.int64)
    if not symbol.any():
        return np.diff(first), nothing, nothing, nothing, nothing, nothing
    row_of = np.repeat(np.arange(rows), np.diff(first))
    new_row = np.ones(n, dtype=bool)
    new_row[1:] = row_of[1:] != row_of[:-1]
    known = np.flatnonzero(symbol > 0)
    # a break goes before a known word unless the word before it is known and of the same row
    broken = np.ones(len(known), dtype=bool)
    broken[1:] = (np.diff(known) > 1) | new_row[known[1:]]
    place = np.arange(len(known)) + np.cumsum(broken)
    text = np.zeros(int(place[-1]) + 2, dtype=np.int64)
    text[place] = symbol[known]
    word_at = np.full(len(text), -1, dtype=np.int64)
    word_at[place] = known
    index = FMIndex(text, phrases.top, sample)
    low, high = index.ranges(phrases.symbols, phrases.lengths)
    hits = high - low
    window = np.repeat(np.arange(len(hits)), hits)
    begin = word_at[index.locate(ragged(low, hits))]
    size = phrases.lengths[window]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + size, -1)
    inside = np.cumsum(cover[:-1]) > 0
    doubt = np.flatnonzero(inside)
    wrong = np.zeros(n + 1, dtype=np.int64)
    wrong[doubt + 1] = ~phrases.same_bytes(raw, starts[doubt], ends[doubt], symbol[doubt])
    if wrong.any():  # two words of equal hash: those occurrences are none
        wrong = np.cumsum(wrong)
        good = wrong[begin + size] == wrong[begin]
        window, begin, size = window[good], begin[good], size[good]
        cover[:] = 0
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + size, -1)
        inside = np.cumsum(cover[:-1]) > 0
    opens, shuts = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | new_row[1:]
    shuts[:-1] &= ~inside[1:] | new_row[1:]
    span_from, span_to = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    span_row = row_of[span_from]
    pair = np.unique(row_of[begin] * np.int64(len(phrases.lengths)) + window)
    hit_row, window = pair // len(phrases.lengths), pair % len(phrases.lengths)
    count = np.diff(phrases.owner_first)[window]
    item = phrases.owners[ragged(phrases.owner_first[window], count)]
    return (np.diff(first), span_row, span_from - first[span_row], span_to - first[span_row],
            np.repeat(hit_row, count), item)


def _merge(old: list, new: list) -> list:
    out: list[list[int]] = []
    for a, b in sorted([*old, *new]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases, shard_bytes: int, sample: int,
            again: bool) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.list_(pa.int64()))
    held: list[pa.RecordBatch] = []

    def shard():
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        texts = table["text"].combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        words, row, begin, end, hit_row, item = search_shard(*utf8(texts), phrases, sample)
        spans: list[list] = [[] for _ in range(len(words))]
        for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist()):
            spans[r].append([a, b])
        items: list[set] = [set() for _ in range(len(words))]
        for r, i in zip(hit_row.tolist(), item.tolist()):
            if phrases.item_ids[i] is not None:
                items[r].add(phrases.item_ids[i])
        if again:
            spans = [_merge(a, b) for a, b in zip(table["spans"].to_pylist(), spans)]
            items = [a | set(b) for a, b in zip(items, table["items"].to_pylist())]
        lists = [sorted(x) for x in items]
        out = pa.table({"id": table["id"], "text": table["text"], "n_words": pa.array(words, pa.int64()),
                        "spans": pa.array(spans, spans_type), "items": pa.array(lists, pa.list_(pa.string()))})
        yield from out.to_batches(max_chunksize=2048)

    size = 0
    for batch in text_slices(batches, "text", shard_bytes):
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= shard_bytes:
            yield from shard()
            size = 0
    if held:
        yield from shard()


def _blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int) -> Iterator:
    """Broadcast phrases of the items, dealt by hash into blocks of about ``block_bytes`` of text."""
    sc = benchmark.sparkSession.sparkContext
    items = pick(benchmark, id=item_col, text=text_col).select(F.col("id").cast("string").alias("id"), "text")
    items = items.where("text is not null")
    sizes = items.select(F.octet_length("text").cast("long").alias("b"))
    total = sizes.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        yield sc.broadcast(Phrases([(r.id, r.text) for r in part], window))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the bytes from the first to the last word of each span."""
    raw, off = utf8(pa.array([text], pa.string()))
    starts, ends, _ = word_bounds(lower_ascii(raw), off, WORD)
    keep = np.ones(len(raw), dtype=bool)
    for a, b in spans:
        keep[starts[a]:ends[b - 1]] = False
    return raw[keep].tobytes().decode()


def cleaned(texts: pa.Array, phrases: Phrases, sample: int) -> tuple[list[str | None], np.ndarray]:
    """(texts without the windows, rows that keep a word or had none): what a cut brings together is searched again."""
    out, keep = texts.to_pylist(), np.ones(len(texts), dtype=bool)
    todo, again = np.arange(len(texts)), False
    while len(todo):
        words, row, begin, end, _, _ = search_shard(*utf8(texts), phrases, sample)
        if again:
            keep[todo] = words > 0
        again = True
        spans: dict[int, list] = {}
        for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist()):
            spans.setdefault(r, []).append((a, b))
        hit = np.array(sorted(spans), dtype=np.int64)
        for r in hit.tolist():
            out[todo[r]] = _cut(out[todo[r]], spans[r])
        todo = todo[hit]
        texts = pa.array([out[i] for i in todo.tolist()], pa.string())
    return out, keep


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, text_col: str = "text",
                         item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 6 << 20,
                         block_bytes: int = 16 << 20, sample: int = 16) -> DataFrame:
    """``docs`` with the spans of :func:`find_contamination` cut out of the texts.

    The cut texts are searched again until no window is left in them. Rows whose
    words all go are dropped; clean rows, wordless ones and the other columns
    stay as they are. With a benchmark of several blocks the passes repeat until
    none finds a window.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    out = docs.toDF(*names)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    blocks = list(_blocks(benchmark, window, item_col, item_text_col, block_bytes))
    while True:
        for phrases in blocks:
            def run(batches, phrases=phrases):
                for batch in text_slices(batches, names[at], shard_bytes):
                    texts, keep = cleaned(batch.column(at), phrases.value, sample)
                    yield batch.set_column(at, names[at], pa.array(texts, pa.string())).filter(pa.array(keep))

            out = out.mapInArrow(run, fields)
        if len(blocks) == 1:
            break
        out = out.checkpoint()
        left = find_contamination(out, benchmark, window, id_col=names[at], text_col=names[at], item_col=item_col,
                                  item_text_col=item_text_col, shard_bytes=shard_bytes, block_bytes=block_bytes, sample=sample)
        if left.where("size(spans) > 0").isEmpty():
            break
    return out.toDF(*docs.columns)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       shard_bytes: int = 6 << 20, block_bytes: int = 16 << 20, sample: int = 16) -> DataFrame:
    """Word spans of every text that lie in a benchmark window, with the items found.

    Words are runs of digits, letters a-z (after lower-casing A-Z) and non-ASCII
    characters. A window is ``window`` consecutive words of an item, or the whole
    of a shorter one. Each task takes its rows in shards of about ``shard_bytes``
    of text (a longer text is a shard), builds an FM-index, searches all windows
    backwards together and locates them by sampled positions; overlapping and
    adjoining occurrences merge into one span. No shuffle. The benchmark is
    searched in blocks of whole items of at most ``block_bytes`` (or one item),
    one pass over the texts each, so what is sent to the tasks is bounded.

    Null or wordless texts and items match nothing; items with a null id are
    searched as others are, but not listed; items with equal ids are one item. Repeated and null document ids are kept row
    by row. Empty tables are allowed on either side; other columns are ignored.
    Returns id, text, n_words, spans (array of [first word, end word)) and items
    (ids as strings, sorted).
    """
    spark = docs.sparkSession
    prepare(spark)
    plain = pick(docs, id=id_col, text=text_col)
    head = f"id {plain.schema['id'].dataType.simpleString()}, text string"
    out = plain
    for block, phrases in enumerate(_blocks(benchmark, window, item_col, item_text_col, block_bytes)):

        def run(batches, phrases=phrases, again=block > 0):
            return _search(batches, phrases.value, shard_bytes, sample, again)

        out = out.mapInArrow(run, f"{head}, n_words long, spans array<array<long>>, items array<string>")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of the item list per document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))
