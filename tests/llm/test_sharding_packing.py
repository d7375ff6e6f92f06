"""Sharding against the definition of longest-processing-time scheduling, packing against the token streams."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from geodemand.llm.packing import encoder, pack_documents, pieces, tokenizer_path
from geodemand.llm.sharding import assign_shards, least_loaded
from tests.llm.tables import documents, empty_documents


def test_shards_balance_and_keep_groups(spark):
    docs, rows = documents(spark)
    got = assign_shards(docs, 4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 8) for i, t, *_ in rows)
    texts = defaultdict(set)
    by_id = {i: t or "" for i, t, *_ in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            texts[by_id[r.doc_id]].add(r.shard)
            assert r.text_crc32 == zlib.crc32(by_id[r.doc_id].encode())
    assert max(map(len, texts.values())) == 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # every group is a unit here, so the loads are those of the plain schedule
    sums = Counter()
    for _, t, *_ in rows:
        sums[t or ""] += len((t or "").encode()) + 8
    plan = least_loaded([(s, t) for t, s in sums.items()], 4)
    want = Counter()
    for t, s in sums.items():
        want[plan[t]] += s
    have = Counter()
    for r in got:
        have[r.shard] += r["size"]
    assert sorted(have.values()) == sorted(want.values())


def test_pooled_groups_stay_balanced(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('ab', cast(id % 97 as int)) || id % 1500 as text")
    got = assign_shards(docs, 5, units_per_shard=64, slot_block=50)
    sizes = [r["sum(size)"] for r in got.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 0.05 * max(sizes)
    bad = got.groupBy("shard").agg({"slot": "max", "*": "count"}).where("`max(slot)` + 1 != `count(1)`")
    assert bad.isEmpty() and got.select("shard", "slot").distinct().count() == 3000


def test_shards_of_nothing(spark):
    assert assign_shards(empty_documents(spark), 3).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 9000), st.sampled_from([0.0, 0.01, 0.2]))
def test_pieces_cover_and_fill_their_class(length, slack):
    cut = pieces(length, 2048, slack)
    assert sum(size for _, size in cut) == length
    assert all(k * size <= 2048 and (k * size >= (1 - slack) * 2048 or size == 2048 // k) for k, size in cut)


def test_packing_is_a_partition_of_the_tokens(spark):
    docs, rows = documents(spark)
    encode = encoder(tokenizer_path())
    want = Counter()
    for i, t, *_ in rows:
        want[i, np.append(encode(t or ""), 1).astype("<u4").tobytes()] += 1
    for parts in (1, 3):
        got = pack_documents(docs.repartition(parts)).collect()
        seqs, docs_seen = defaultdict(list), defaultdict(list)
        for r in got:
            assert len(r.ids) == 4 * r.length > 0
            seqs[r.sequence_id].append(r)
            docs_seen[r.doc_id].append(r)
        padded = 0
        for s in seqs.values():
            s.sort(key=lambda r: r.offset)
            total = 0
            for r in s:
                assert r.offset == total
                total += r.length
            assert total <= 2048
            padded += 0 if total & (total - 1) == 0 else 2048 - total
        assert padded <= 0.01 * sum(r.length for r in got)
        for i, found in docs_seen.items():
            if i is not None and sum(k[0] == i for k in want.elements()) == 1:
                found.sort(key=lambda r: r.start)
                assert [r.start for r in found] == list(np.cumsum([0] + [r.length for r in found[:-1]]))
                assert want[i, b"".join(bytes(r.ids) for r in found)] == 1
        assert sum(r.length for r in got) == sum(len(b) // 4 for _, b in want.elements())
    assert pack_documents(empty_documents(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300) | st.text(alphabet=" \n\t'a1é<|endoftext>", max_size=200))
def test_fast_encoder_equals_the_tokenizer_file(text):
    from tokenizers import Tokenizer
    if not _TOK:
        _TOK["file"] = Tokenizer.from_file(tokenizer_path())
    tok = _TOK["file"]
    tok.encode_special_tokens = True
    assert encoder(tokenizer_path())(text).tolist() == tok.encode(text, add_special_tokens=False).ids


_TOK: dict = {}


def test_long_runs_are_encoded():
    encode = encoder(tokenizer_path())
    for text in (" " * 300_000, "a" * 200_000):
        assert encode(text).size > 0


def test_added_tokens_are_those_of_the_tokenizer_file(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["a<|endoftext|>b", "<|endoftext|>", "one <|endoftext|> two<|endoftext|><|endoftext|>\n", "<|endoftext| >", "plain é"]
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert want[0] == [64, 50256, 65, 1]
    got = defaultdict(list)
    for r in sorted(pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.start):
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == want
