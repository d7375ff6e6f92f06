"""SimHash, embeddings, passages and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from geodemand.llm.common import pick
from geodemand.llm.components import Forest, connected_components
from geodemand.llm.embed_dedup import Scheme, bucket_keys, choose_scheme, embedding_groups, hadamard
from geodemand.llm import passages
from geodemand.llm.passages import compact_windows, distinct_tokens, drifted_runs, matching_ranges, open_windows, passages_of, rare_tokens, repeated_passages, shared_runs, verified
from geodemand.llm.simhash import (SEGMENTS, codeword, drop_near_copies, fingerprint, fingerprint_components, fuzzy_keys,
                                   home_keys, simhash_groups)
from tests.llm.tables import documents, empty_documents


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_forest(links):
    forest = Forest(31)
    for i in range(0, len(links), 7):
        part = np.array(links[i:i + 7])
        forest.union(part[:, 0], part[:, 1])
    assert forest.find(np.arange(31)).tolist() == roots(31, links)


def test_components_of_paths_stars_and_random_links(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 80)]
    links += [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(150)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    whole = [(a, b) for a, b in links if b is not None]
    want = roots(500, whole)
    assert got == {x: want[x] for ab in whole for x in ab if ab[0] != ab[1]}


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 5000)
    near = codeword(v)
    for _ in range(3):  # a codeword and all words within three bits of it decode to it
        word = np.array([next(w for w in range(m << 11, (m + 1) << 11) if codeword(np.array([w]))[0] == m and _is_codeword(w)) for m in range(0, 4096, 997)])
        flips = [1 << b for b in rng.choice(23, 3, replace=False)]
        assert (codeword(word ^ flips[0] ^ flips[1] ^ flips[2]) == word >> 11).all()
    assert near.min() >= 0 and near.max() < 4096


def _is_codeword(w):
    from geodemand.llm.simhash import _PARITY
    return (w & 2047) == _PARITY[w >> 11]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_three_bits_apart_share_a_key(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    pair = np.array([fp, other], dtype=np.uint64)
    who, keys = fuzzy_keys(pair)
    homes = home_keys(pair)
    for i in (0, 1):  # either one meets the other at home
        assert set(keys[who == i].tolist()) & set(homes[:, 1 - i].tolist())
    assert sum(b for _, b in SEGMENTS) == 64 and np.bincount(who).max() <= 108


def _fingerprint_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBé \t\x0b\x85 \x1c.", max_size=60))
def test_fingerprints(text):
    assert fingerprint(text.encode(), 3, 42) == _fingerprint_by_hand(text)


@pytest.mark.parametrize("hot", [8192, 2])
def test_components_of_close_fingerprints(spark, hot):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:30].tolist():
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    fps.sort()
    unsigned = fps.view(np.uint64)
    close = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= 3
    links = [(i, j) for i, j in zip(*np.nonzero(close)) if i < j]
    want = roots(len(fps), links)
    frame = spark.createDataFrame([(int(x),) for x in fps for _ in range(2)], "fp long")
    got = {r.fp: r.root for r in fingerprint_components(frame, 3, hot=hot).collect()}
    linked = {i for ab in links for i in ab}
    assert got == {int(fps[i]): int(fps[want[i]]) for i in linked}


def test_simhash_of_awkward_rows(spark):
    docs, rows = documents(spark)
    prints = [_fingerprint_by_hand(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    root = roots(len(rows), links)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[root[i]].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    want = sorted(((r[0], f"{prints[i]:016x}", least[root[i]]) for i, r in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()), key=str)
    assert got == want
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.i for r in pick(kept, i="doc_id").collect()]
    named = [x for x in least.values() if x is not None]
    assert sorted(x for x in ids if x is not None) == sorted(named)
    assert sum(x is None for x in ids) == sum(v is None for v in least.values())
    assert simhash_groups(empty_documents(spark)).count() == 0 and drop_near_copies(empty_documents(spark)).count() == 0


def test_hadamard_keeps_lengths_and_keys_do_not_depend_on_the_batch():
    x = np.random.default_rng(0).normal(size=(40, 32))
    y = hadamard(x)
    assert np.allclose((y**2).sum(1), 32 * (x**2).sum(1)) and np.allclose(hadamard(y), 32 * x)
    scheme = Scheme(2, 3, 4, 7)
    whole = bucket_keys(x, scheme)
    assert all((bucket_keys(x[i:i + 1], scheme)[0] == whole[i]).all() for i in range(40))


@pytest.mark.parametrize("hot", [4096, 5])
def test_embeddings_against_brute_force(spark, hot):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 24)) * 0.25, base[:10] * 3, base[:1].repeat(15, 0),
                        base[0] + rng.normal(size=(40, 24)) * 0.2, [1e200 * base[3], 1e-200 * base[4]]])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = unit @ unit.T
    assert not ((cos > 0.9 - 1e-9) & (cos < 0.9 + 1e-9)).any()
    odd = [(500, None, 0), (501, [], 0), (502, [0.0] * 24, 0), (503, [None] + [1.0] * 23, 0), (504, [float("nan")] + [1.0] * 23, 0),
           (505, [float("inf")] * 24, 0), (506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0), (None, x[0].tolist(), 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in embedding_groups(frame, 0.9, hot=hot, recall=0.9999).collect()}
    same0 = np.flatnonzero(cos[0] >= 0.9)
    links = [(i, j) for i, j in zip(*np.nonzero(cos >= 0.9)) if i < j]
    want = roots(len(x), links)
    for i in range(len(x)):
        extra = i in same0 or i == 0  # the row with a null id equals row 0
        assert got[i].n_links == (cos[i] >= 0.9).sum() - 1 + extra, i
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    for i in range(500, 506):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[506].n_links, got[507].component_id, got[507].kept) == (1, 506, False)
    assert got[None].component_id == 0 and not got[None].kept and len(got) == len(rows) + len(odd)
    assert embedding_groups(frame.limit(0)).count() == 0


def test_single_precision_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16)).astype(np.float32)
    x = np.concatenate([base, base + rng.normal(size=base.shape).astype(np.float32) * np.float32(0.3)]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embedding_groups(frame, 0.9, recall=0.9999).collect()}
    assert [got[i] for i in range(60)] == want.tolist() and 0 < want.sum()


def test_scheme_follows_size_and_threshold():
    small, large = choose_scheme(1000, 64, 0.9, 0.99), choose_scheme(10_000_000, 64, 0.9, 0.99)
    assert large.functions > small.functions and choose_scheme(1000, 64, 0.7, 0.99).tables > small.tables
    assert choose_scheme(10, 1, 0.9, 0.99).probes >= 1


def _windows_by_hand(value, least):
    out = set()
    for c, v in enumerate(value):
        if not v:
            continue
        a = b = c
        while a > 0 and value[a - 1] > v:
            a -= 1
        while b + 1 < len(value) and value[b + 1] >= v:
            b += 1
        if b - a + 1 >= least:
            out.add((c, a, b))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=90), st.integers(1, 20))
def test_compact_windows(value, least):
    got = compact_windows(np.array(value, dtype=np.uint64), least)
    assert set(zip(*(x.tolist() for x in got))) == _windows_by_hand(value, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.integers(1, 10))
def test_matching_ranges(same, least):
    same = np.array(same, dtype=bool)
    got = matching_ranges(same, 0.75, least)
    longest = max((j - i for i in range(len(same)) for j in range(i + least, len(same) + 1) if same[i:j].mean() >= 0.75 - 1e-9), default=0)
    assert max((j - i for i, j in got), default=0) == longest
    assert all(same[i:j].mean() >= 0.75 - 1e-9 and j - i >= least for i, j in got)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_an_exact_run_is_a_passage_without_a_look_at_its_tokens(monkeypatch):
    monkeypatch.setattr(passages, "_stretched", lambda *a: pytest.fail("tokens of equal runs were compared"))
    s, t = np.arange(200), np.arange(-5, 195)  # equal at the offset 5
    assert passages_of(s, t, np.array([[20, 120, 5]]), 0.8, 46) == [(20, 120, 25, 125, 1.0)]
    assert passages_of(s, t, np.array([[20, 66, 5]]), 0.8, 46) == [(20, 66, 25, 71, 1.0)]


def _drifted_by_hand(a, b, lo, hi, shift):
    drift = max(16, (hi - lo) // 4)
    lo, hi, begin, end = max(lo - drift, 0), min(hi + drift, len(a)), max(lo + shift - drift, 0), max(0, hi + shift + drift)
    part = b[begin:end].tolist()
    at = {x: begin + k for k, x in enumerate(part) if x and part.count(x) == 1}
    turns = [at[x] - i for i, x in enumerate(a[lo:hi].tolist(), lo) if x in at]
    return [x for s in sorted({s for s in turns if turns.count(s) >= 4} - {shift})
            for x in shared_runs(a, b, lo, hi, s) if x[1] - x[0] >= 4]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(20, 120), st.integers(0, 12))
def test_drifted_runs(seed, n, edits):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 400, n)
    b = a.copy()
    for _ in range(edits):
        at = int(rng.integers(0, len(b)))
        b = np.insert(b, at, rng.integers(0, 400)) if rng.random() < 0.5 or len(b) < 5 else np.delete(b, at)
    seen = np.full((2, 400), -1)
    for _ in range(4):  # the places of one call are no places in the next
        lo, hi = np.sort(rng.integers(0, n + 1, 2)).tolist()
        shift = int(rng.integers(-5, 6))
        assert drifted_runs(a, b, lo, hi, shift, seen) == _drifted_by_hand(a, b, lo, hi, shift)


def test_open_windows():
    rng = np.random.default_rng(3)
    s, t, least = np.arange(150), np.arange(140), 20
    for _ in range(50):
        centre, shift = rng.integers(20, 120, 3), rng.integers(-10, 11, 3)
        links = np.column_stack([shift, centre, centre, np.zeros(3, int), centre])
        found = [(30, 80, 28, 78, 1.0)]
        for side, got in enumerate(open_windows(s, t, links, found, least)):
            begin, end, length = (30, 80, 150) if side == 0 else (28, 78, 140)
            want = {x for c in (centre + side * shift).tolist() for x in range(c - least + 1, c + 1)
                    if x >= 0 and x + least + 4 <= length and (x < begin or x + least + 4 > end)}
            assert got.tolist() == sorted(want)


def test_windows_of_many_texts_come_as_few_batches():
    rng = random.Random(5)
    line = _prose(rng, 20)  # too short to be a passage
    texts = [" ".join(_prose(rng, 60) + line + _prose(rng, 40 + i)) for i in range(6)]
    blobs = [zstandard.ZstdCompressor().compress(x.encode()) for x in texts]
    pairs = [(0, 1), (0, 2), (0, 3), (4, 5)]
    link = {"shift": 0, "lo": 60, "hi": 75, "hash": 0, "centre": 66}
    columns = [pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), pa.array([blobs[a] for a, _ in pairs]),
               pa.array([blobs[b] for _, b in pairs]), pa.array([[link]] * 4, pa.list_(pa.struct([(c, pa.int64()) for c in link])))]
    batch = pa.RecordBatch.from_arrays(columns, names=["a", "b", "text_a", "text_b", "links"])
    got = list(passages._verify(iter([batch]), 0.8, 46, 1, False))
    assert len(got) <= 3  # compared ranges, windows, open windows
    rows = [r for x in got for r in x.to_pylist() if r["b_end"] < 2]
    assert sorted((r["a"], r["b"], r["a_start"], r["b_end"]) for r in rows) == [(i, 21, 66, k) for i in range(6) for k in (0, 1)]


def test_ranges_need_as_many_functions_as_asked():
    s = np.arange(1, 300)
    links = np.array([[0, 10, 60, 0, 30], [0, 50, 100, 2, 70], [0, 180, 240, 1, 200], [3, 5, 20, 0, 9]])
    assert [x[:4] for x in verified(s, s, links, 0.8, 46, 2)] == [(10, 105, 10, 105)]
    assert [x[:4] for x in verified(s, s, links, 0.8, 46, 1)] == [(10, 105, 10, 105), (180, 245, 180, 245)]
    assert verified(s, s, links[:0], 0.8, 46, 1) == []


def _prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_passages_are_found_and_clean_rows_left_alone(spark):
    rng = random.Random(6)
    docs, planted = {}, defaultdict(set)
    shared = [_prose(rng, n) for n in (50, 51, 60, 120, 400)]
    common = _prose(rng, 30)  # too short to be a passage, in every row
    for i in range(120):
        words = _prose(rng, 80) + common + _prose(rng, 60)
        if i % 3 == 0:
            k = i // 3 % 5
            at = rng.randrange(len(words))
            words[at:at] = shared[k]
            planted[k].add(i)
        docs[i] = words
    for i in range(200, 240):  # near copies: a word in every sixty changed
        words = list(docs[1])
        for at in range(rng.randrange(60), len(words), 60):
            words[at] = "edit"
        docs[i] = words
    rows = [(i, " ".join(w), "x") for i, w in docs.items()]
    rows += [(300 + i, " ".join(docs[2]), "x") for i in range(25)] + [(1, " ".join(docs[1]), "x")] * 2
    rows += [(400, None, "x"), (401, "", "x"), (402, " ".join(common), "x"), (None, " ".join(docs[2]), "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, similarity string").repartition(7)
    got = repeated_passages(frame, hashes=4).collect()
    covered = defaultdict(set)
    for r in got:
        assert r.similarity >= 0.8 and r.end_word - r.start_word >= 50 and r.source_end - r.source_start >= 50
        assert r.source_doc_id is None or r.doc_id is None or r.source_doc_id < r.doc_id
        for i, a, b in ((r.doc_id, r.start_word, r.end_word), (r.source_doc_id, r.source_start, r.source_end)):
            covered[i].update(range(a, b))
    for k, members in planted.items():
        for i in members:
            text = docs[i]
            at = next(p for p in range(len(text)) if text[p:p + len(shared[k])] == shared[k])
            assert set(range(at, at + len(shared[k]))) <= covered[i], (k, i)
    copies = {r.doc_id for r in got if r.source_doc_id == 2 and r.similarity == 1.0 and r.end_word == len(docs[2])}
    assert copies >= {*range(300, 325), None}
    near = sum(bool(covered[i]) for i in range(200, 240))
    assert near == 40
    clean = {i for i in range(120) if i % 3 and i not in (1, 2)} | {400, 401, 402}
    assert not clean & set(covered)
    assert repeated_passages(frame.limit(0)).count() == 0


def test_edited_passages_are_mostly_found(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        words = _prose(rng, 70)
        rows.append((2 * i, " ".join(_prose(rng, 90) + words + _prose(rng, 90))))
        words[rng.randrange(15, 55)] = "edit"
        rows.append((2 * i + 1, " ".join(_prose(rng, 90) + words + _prose(rng, 90))))
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 54 and all(i % 2 for i in got)


def test_passages_with_repeated_phrases_are_found(spark):
    rng = random.Random(12)
    rows = []
    for i, phrase in enumerate([5, 8, 12, 20] * 6):
        words, again = _prose(rng, 60), _prose(rng, phrase)
        words[4:4 + phrase] = words[55 - phrase:55] = again
        for k in (0, 1):
            rows.append((2 * i + k, " ".join(_prose(rng, 80 + k) + words + _prose(rng, 90))))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 48, 2))
    for r in got:
        assert r.similarity >= 0.8 and r.source_doc_id == r.doc_id - 1
        assert (r.start_word <= 81 and r.end_word >= 141 and r.source_start <= 80 and r.source_end >= 140)


def test_passages_with_a_word_put_in_or_left_out_are_found_whole(spark):
    rng = random.Random(13)
    rows, sizes = [], [60, 70, 80, 88, 110, 300] * 5
    for i, n in enumerate(sizes):
        words = _prose(rng, n)
        other = list(words)
        if i % 2:
            other.insert(n // 2 + rng.randrange(-4, 5), "new")
        else:
            del other[n // 2 + rng.randrange(-4, 5)]
        rows.append((2 * i, " ".join(_prose(rng, 90) + words + _prose(rng, 90))))
        rows.append((2 * i + 1, " ".join(_prose(rng, 70) + other + _prose(rng, 90))))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.similarity >= 0.8 and r.source_doc_id == r.doc_id - 1 for r in got)
    whole = {r.doc_id for r in got if r.source_start <= 90 and r.source_end >= 90 + sizes[r.doc_id // 2] and r.start_word <= 70}
    assert len(whole) >= 27 and len(got) == len({r.doc_id for r in got})


def test_repeats_behind_a_frequent_line_are_found(spark):
    rng = random.Random(14)
    rows, want = [], set()
    for g in range(40):  # 30 texts share 44 words, two of them the eight after it
        words = _prose(rng, 52)
        for i in range(30):
            own = words if i in (17, 23) else words[:44]
            rows.append((100 * g + i, " ".join(_prose(rng, 60) + own + _prose(rng, 60))))
        want.add((100 * g + 23, 100 * g + 17))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeated_passages(frame).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} >= want
    for r in got:
        assert r.similarity >= 0.8 and r.end_word - r.start_word >= 50 and r.source_end - r.source_start >= 50
    assert len({(r.doc_id, r.source_doc_id, r.start_word) for r in got}) == len(got)


def test_edited_repeats_behind_a_frequent_line_are_found(spark):
    rng = random.Random(16)
    rows, want = [], set()
    for g in range(60):  # 12 texts share 30 words, two of them 26 more, one of which differs
        words = _prose(rng, 56)
        edited = list(words)
        edited[rng.randrange(32, 52)] = "edit"
        for i in range(12):
            own = {5: words, 9: edited}.get(i, words[:30])
            rows.append((100 * g + i, " ".join(_prose(rng, 60) + own + _prose(rng, 60))))
        want.add((100 * g + 9, 100 * g + 5))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {(r.doc_id, r.source_doc_id) for r in got}
    assert found <= want and len(found) >= 57
    for r in got:
        assert r.similarity >= 0.8 and r.end_word - r.start_word >= 50 and r.source_end - r.source_start >= 50
    assert len({(r.doc_id, r.source_doc_id, r.start_word) for r in got}) == len(got)


def test_leaders_sent_to_all_tasks_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(12)
    line, tail = _prose(rng, 40), [_prose(rng, 60) for _ in range(3)]
    rows = [(i, " ".join(_prose(rng, 30) + line + (tail[i % 4] if i % 4 < 3 else _prose(rng, 60)))) for i in range(24)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, repeated_passages(frame).collect()))
    assert {r[0] % 4 for r in got} == {0, 1, 2} and len({r[0] for r in got}) == 15
    monkeypatch.setattr(passages, "_FEW", -1)
    assert sorted(map(tuple, repeated_passages(frame).collect())) == got


@pytest.mark.parametrize("middle", [0, 1, 2])
def test_repeats_of_repeats_are_found(spark, middle):
    rng = random.Random(17)
    rows, want = [], set()
    for g in range(60):  # one of three texts is like both others, which are unlike each other
        words = _prose(rng, 60)
        others = [list(words), list(words)]
        others[0][rng.randrange(15, 25)] = others[1][rng.randrange(35, 45)] = "edit"
        others.insert(middle, words)
        for i, own in enumerate(others):
            rows.append((3 * g + i, " ".join(_prose(rng, 60) + own + _prose(rng, 60))))
        want.update((3 * g + max(i, middle), 3 * g + min(i, middle)) for i in range(3) if i != middle)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(want & {(r.doc_id, r.source_doc_id) for r in got}) >= 116


def test_rare_tokens_of_windows():
    rng = np.random.default_rng(8)
    least, share = 12, 0.75
    for _ in range(30):
        s = rng.integers(1, 50, 100)
        other = rng.random(50) < 0.85  # which tokens another text has
        near, free = rng.random(100) < 0.6, rng.random(100) < 0.3
        at = np.flatnonzero(other[s[:90]])
        flags = 2 * near[at] + 4 * (near & free)[at]
        distinct = distinct_tokens(s, at, least)
        assert distinct.tolist() == [len(set(s[i:i + least].tolist())) if i + least <= 100 else distinct[k] for k, i in enumerate(at.tolist())]
        want, want_open = set(), set()
        for k in np.flatnonzero(flags & 2).tolist():
            inside = [j for j in range(len(at)) if at[k] <= at[j] < at[k] + least]
            own = sorted({int(s[at[j]]) for j in inside})
            left = int(distinct[k] * (1 - share)) - (int(distinct[k]) - len(own))
            if left >= 0:
                taken = {j for j in inside if s[at[j]] in own[:left + 1]}
                want |= taken
                want_open |= taken if flags[k] & 4 else set()
        some, open_ = rare_tokens(at, s[at].astype(np.uint64), distinct, flags, least, share)
        assert set(np.flatnonzero(some).tolist()) == want and set(np.flatnonzero(open_).tolist()) == want_open


@pytest.mark.parametrize("kind", ["long", "string"])
def test_all_but_the_smallest_id_are_repeats(spark, kind):
    rng = random.Random(15)
    rows, want = [], set()
    for g in range(10):
        words, own = _prose(rng, 60), [rng.randrange(10**6) for _ in range(6)]
        ids = [f"doc-{i:09d}" if kind == "string" else i for i in own]
        rows += [(i, " ".join(_prose(rng, 60) + words + _prose(rng, 60))) for i in ids]
        want.update(set(ids) - {min(ids)})
    words = _prose(rng, 80)
    rows += [(None, " ".join(words + _prose(rng, 70))), (rows[0][0], " ".join(_prose(rng, 70) + words))]
    for parts in (1, 4):
        got = repeated_passages(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(parts)).collect()
        assert {r.doc_id for r in got} == want | {None}
        assert all(r.source_doc_id is not None and (r.doc_id is None or r.source_doc_id < r.doc_id) for r in got)


def test_windows_of_a_bucket_are_one_row():
    """The shuffle takes a row for each bucket of keys, not for each window; what meets is what equal keys bring together."""
    rng = np.random.default_rng(8)
    words = rng.integers(0, 400, (30, 300))
    words[10:20, 100:200] = words[0, 100:200]
    texts = [" ".join(f"w{x}" for x in row) for row in words]
    tasks = [pa.RecordBatch.from_arrays([pa.array(texts[i:i + 10]), pa.array(range(i, i + 10), pa.int64())], names=["text", "rank"]) for i in (0, 10, 20)]
    rows = [b for task in tasks for b in passages._emit_windows(iter([task]), 3, 46, 4)]
    assert sum(b.num_rows for b in rows) <= 3 * 2 * 16
    assert {c.type for b in rows for c in b.columns[1:]} == {pa.binary()}
    got = set()
    for bucket in range(-8, 8):
        held = [b.filter(pa.array(np.asarray(b.column(0)) == bucket)) for b in rows]
        for links in passages._meet(iter(held)):
            got |= set(zip(*(links.column(i).to_pylist() for i in range(7))))

    nodes = np.array([passages.xxhash.xxh64_intdigest(x, 42) for x in texts], dtype=np.uint64).view(np.int64)
    keys: dict = {}
    for task in range(3):
        own = slice(10 * task, 10 * task + 10)
        for k, n, p in zip(*passages._text_windows(*passages.utf8(pa.array(texts[own])), nodes[own], 3, 46)):
            keys.setdefault(int(k), []).append((task, int(np.flatnonzero(nodes == n)[0]), int(n), int(p)))
    want = set()
    for members in keys.values():
        heads = [min((m for m in members if m[0] == task), key=lambda m: m[1:], default=None) for task in range(3)]
        heads = [h for h in heads if h]
        least = min(heads, key=lambda m: m[1:])
        for f, m in [(heads[[h[0] for h in heads].index(m[0])], m) for m in members] + [(least, h) for h in heads]:
            if f[2] != m[2]:
                for links in passages._link_rows(*(np.array([x]) for x in (*f[2:], *m[2:]))):
                    want |= set(zip(*(links.column(i).to_pylist() for i in range(7))))
    assert got == want and got


@given(seed=st.integers(0, 10**6), tokens=st.integers(1, 4))
def test_runs_of_spans(seed, tokens):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, tokens + 1, 40), rng.integers(0, tokens + 1, 30)
    lo, shift = rng.integers(-5, 40, 9), rng.integers(-45, 35, 9)
    hi = lo + rng.integers(0, 30, 9)
    assert passages.runs_of_spans(a, b, lo, hi, shift) == [shared_runs(a, b, *x) for x in zip(lo.tolist(), hi.tolist(), shift.tolist())]


@given(seed=st.integers(0, 10**6), leaders=st.sampled_from([1, 2, 4]), done=st.sampled_from([0, 1, 2]))
def test_rounds_link_the_first_open_texts_with_all_others(seed, leaders, done):
    rng = np.random.default_rng(seed)
    rows = {(int(t), int(n), int(p)): [int(o), 1, int(n) % 3] for t, n, p, o in zip(*(rng.integers(0, k, 40) for k in (4, 6, 5, 2)))}
    marks = [x for x in rows if rng.random() < 0.3] if done else []

    def run(rows, marks):
        own = [(*k, *v) for k, v in rows.items()] + [(*k, 2, 1, 0) for k in marks * 2]
        own = [own[i] for i in rng.permutation(len(own))]
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*own)], names=list(passages._STATE))
        out = [x for b in passages._round(iter([batch]), done, leaders) for x in zip(*b.to_pydict().values())]
        assert len(out) == len(set(out))
        return {x[1:] for x in out if not x[0]}, {x[1:] for x in out if x[0]}

    def leading(rows, token, n):
        return sorted({(v[2], k[1]) for k, v in rows.items() if k[0] == token and v[0]})[:n]

    left = {k: [v[0] and int(k not in marks), *v[1:]] for k, v in rows.items() if (v[2], k[1]) not in leading(rows, k[0], done)}
    left = {k: v for k, v in left.items() if len({x[1] for x in left if x[0] == k[0]}) > 1 and any(w[0] for x, w in left.items() if x[0] == k[0])}
    links = set()
    for token in {k[0] for k in left}:
        lead = leading(left, token, leaders)
        for i, (_, to) in enumerate(lead):
            to_at = min(k[2] for k, v in left.items() if k[:2] == (token, to) and v[0])
            links |= {(token, to, to_at, k[1], k[2], v[1]) for k, v in left.items() if k[0] == token and (v[2], k[1]) not in lead[:i + 1]}
    assert run(rows, marks) == ({(*k, *v) for k, v in left.items()}, links)


def test_shuffle_files_of_passages_go_as_the_steps_end(spark, monkeypatch):
    """What a step has shuffled is not kept until the driver happens to collect its garbage; the session's setting is."""
    seen = []
    monkeypatch.setattr(passages, "_ranked", lambda rows, f=passages._ranked: (seen.append(spark.conf.get(passages._CLEANED)), f(rows))[1])
    before = spark.conf.get(passages._CLEANED, "false")
    text = "\u00c4pfel " + " ".join(f"O{i}-Ab{i}" for i in range(30))  # capitals and signs count as in the tokens
    got = repeated_passages(spark.createDataFrame([(1, text), (2, text), (3, "short copy"), (4, "short copy")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(2, 0, 61, 1, 0, 61, 1.0)]
    assert seen == ["true"]
    assert spark.conf.get(passages._CLEANED, "false") == before
