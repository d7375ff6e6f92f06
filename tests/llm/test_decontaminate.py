"""FM-index against naive search; contamination against windows by hand."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from geodemand.llm.common import hash_words, utf8, word_bounds
from geodemand.llm.decontaminate import WORD, Phrases, cleaned, contamination_digest, find_contamination, remove_contamination
from geodemand.llm.fm_index import FMIndex, suffix_order
from tests.llm.tables import documents, empty_documents

_RUNS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _RUNS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(text, items, window):
    w = words(text)
    hit, found = [False] * len(w), set()
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == v[k:k + n]:
                    hit[j:j + n] = [True] * n
                    if i is not None:
                        found.add(str(i))
    return len(w), sum(hit), sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=120), st.integers(1, 9), st.data())
def test_index_finds_what_is_there(symbols, sample, data):
    text = np.array([*symbols, 0], dtype=np.int64)
    top = 5 if data.draw(st.booleans()) else 40_000  # wide symbols double from short keys
    order = suffix_order(text, top)
    # breaks sort by place: compare suffixes up to their break, then by position
    key = [(tuple(text[i:i + int(np.argmax(text[i:] == 0))].tolist()) + (0,), i + int(np.argmax(text[i:] == 0))) for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: key[i])
    index = FMIndex(text, top, sample)
    patterns = [data.draw(st.lists(st.integers(1, 5), min_size=1, max_size=4)) for _ in range(6)]
    matrix = np.zeros((6, 4), dtype=np.int64)
    for k, p in enumerate(patterns):
        matrix[k, :len(p)] = p
    low, high = index.ranges(matrix, np.array([len(p) for p in patterns]))
    for k, p in enumerate(patterns):
        want = [i for i in range(len(text) - len(p) + 1) if text[i:i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_long_repeats_sort():
    text = np.array(([3, 1, 2] * 700 + [0]) * 3, dtype=np.int64)
    index = FMIndex(text, 3, 8)
    low, high = index.ranges(np.array([[1, 2, 3, 1, 2]]), np.array([5]))
    want = [i for i in range(len(text) - 4) if text[i:i + 5].tolist() == [1, 2, 3, 1, 2]]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abZ .é0", max_size=40), min_size=1, max_size=6))
def test_words_and_hashes(texts):
    raw, off = utf8(pa.array(texts))
    lower = np.frombuffer(bytes(raw).lower(), np.uint8)
    starts, ends, first = word_bounds(lower, off, WORD)
    got = [[bytes(lower[a:b]).decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first, first[1:])]
    assert got == [words(t) for t in texts]
    hashes = hash_words(lower, starts, ends).tolist()
    flat = [w for row in got for w in row]
    assert len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))


def test_contamination_by_hand(spark):
    docs, rows = documents(spark)
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    source = next(t for t in text.values() if t and 60 < len(words(t)) < 300)
    items = [(1, " ".join(words(source)[5:30])), (10, " ".join(words(source)[20:45]).upper()), (2, "CO BAN"), (3, None), (4, " .. "),
             (5, "never seen anywhere"), (2, "ban"), (None, source), (6, "word5 and5 word6")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    merged = {}
    for i, t in items:  # items without an id are searched, but not listed
        merged.setdefault(i, []).append(t)
    flat = [(i, t) for i, ts in merged.items() for t in ts]
    want = sorted((i, *by_hand(t, flat, 10)[:2], ",".join(by_hand(t, flat, 10)[2])) for i, t, *_ in rows if i is not None)
    for block in (1 << 20, 40):
        found = find_contamination(docs.repartition(3), bench, 10, shard_bytes=4000, block_bytes=block, sample=4)
        got = sorted((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), ",".join(r["items"])) for r in found.collect() if r.doc_id is not None)
        assert got == want
    digest = contamination_digest(find_contamination(docs, bench, 10)).collect()
    assert len(digest) == len(rows) and all(r.contaminated == (r.n_hit > 0) for r in digest)
    for block in (1 << 20, 40):
        clean = remove_contamination(docs, bench, 10, block_bytes=block)
        assert clean.columns == docs.columns
        left = clean.collect()
        for r in left:
            n, hit, _ = by_hand(r["text"], flat, 10)
            assert hit == 0
        assert sum(r["text"] is None for r in left) == sum(r[1] is None for r in rows)
        untouched = {r.doc_id: r["text"] for r in left}
        assert all(untouched[i] == t for i, t in text.items() if by_hand(t, flat, 10)[1] == 0)
    assert find_contamination(empty_documents(spark), bench).count() == 0
    nothing = bench.limit(0)
    assert find_contamination(docs, nothing).where("size(items) > 0").isEmpty()
    assert remove_contamination(docs, nothing).count() == len(rows)


def test_what_a_cut_joins_is_cut_too():
    phrases = Phrases([("1", "a b c d")], 4)
    texts, keep = cleaned(pa.array(["x a b a b c d c d y", "a b c d", "", None, "a b c"]), phrases, 4)
    assert [words(t) for t in texts[:1]] == [["x", "y"]] and keep.tolist() == [True, False, True, True, True]
    assert texts[3] is None and texts[4] == "a b c"
