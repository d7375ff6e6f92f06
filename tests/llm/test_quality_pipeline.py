"""Importance resampling by hand and on held-out labels; the pipeline stage by stage against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geodemand.llm.common import hash_words, mix64, utf8
from geodemand.llm.langid import held_out, identify, learn_languages, training_rows
from geodemand.llm.packing import encoder, tokenizer_path
from geodemand.llm.resample import _maybe_in, features, kth_largest, log_ratio, resample
from geodemand.llm.secrets import find_spans, redacted
from tests.llm.tables import documents, empty_documents
from tests.llm.test_decontaminate import by_hand
from tests.llm.test_near_duplicates import _fingerprint_by_hand, roots


def _tokens(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", text or "")


def _features_by_hand(text, buckets):
    tokens = _tokens(text)
    raw, off = utf8(pa.array(tokens or [""]))
    h = hash_words(raw, off[:-1], off[1:]) if tokens else np.zeros(0, np.uint64)
    pairs = mix64(h[:-1] * np.uint64(3) + h[1:])
    return Counter((np.concatenate((h, pairs)) % np.uint64(buckets)).tolist())


def test_weights_by_hand(spark):
    docs, rows = documents(spark)
    targets = [2, 8, 11, 12, None, 999]
    ids = spark.createDataFrame([(t,) for t in targets] * 2, "x long")
    got = resample(docs, ids, 0.3, buckets=512).collect()
    bags = [_features_by_hand(r[1], 512) for r in rows]
    raw, target = np.zeros(512), np.zeros(512)
    for r, bag in zip(rows, bags):
        for b, n in bag.items():
            raw[b] += n
            target[b] += n * (r[0] in targets and r[0] is not None)
    ratio = log_ratio(target, raw)
    want = defaultdict(list)
    for r, bag in zip(rows, bags):
        want[r[0]].append(sum(n * ratio[b] for b, n in bag.items()))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append(r.log_weight)
    assert have.keys() == want.keys()
    assert all(np.allclose(sorted(have[k]), sorted(want[k]), atol=1e-6) for k in want)
    least = sorted((r.gumbel_key for r in got), reverse=True)[int(len(rows) * 0.3) - 1]
    assert all(r.kept == (r.gumbel_key >= least) for r in got)
    assert {r.log_weight for r in resample(docs, ids.limit(0), 0.5).collect()} == {0.0}
    assert resample(empty_documents(spark), ids, 0.5).count() == 0
    assert not any(r.kept for r in resample(docs, ids, 0.0).collect())
    other = {r.doc_id: r.log_weight for r in resample(docs, ids.select(F.col("x").cast("int")), 0.3, buckets=512).collect()}
    assert other.keys() == have.keys()  # ids of another type: the same weights
    assert all(any(math.isclose(w, v, abs_tol=1e-6) for v in have[k]) for k, w in other.items())


def test_slots_keep_every_target_and_few_others(spark):
    rows = spark.range(20_000).select("id", F.lit("t").alias("text"))
    ids = spark.range(0, 20_000, 20).toDF("id")
    kept = {r.id for r in _maybe_in(rows, ids).collect()}
    assert kept >= set(range(0, 20_000, 20)) and len(kept) < 1_200
    assert _maybe_in(rows, ids.select(F.col("id").cast("int"))).count() == 20_000


def test_features_do_not_cross_rows():
    texts = ["a b", "", "b", None, "x ## é"]
    of, bucket = features(*utf8(pa.array(texts)), 1 << 20)
    for i, t in enumerate(texts):
        assert Counter(bucket[of == i].tolist()) == _features_by_hand(t, 1 << 20)


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_kth_largest(spark, few):
    values = [float(i % 50) * 1e-300 for i in range(200)] + [1e300, -1e300, 0.5, 0.5, 0.5] + [math.pi] * 40
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 30, 41, 42, 44, 45, 120, len(values), 10**9):
        assert kth_largest(frame, "v", k, bins=8, few=few) == ranked[min(k, len(values)) - 1]
    assert kth_largest(frame, "v", 0) is None and kth_largest(frame.limit(0), "v", 3) is None


def test_gumbel_draws_in_proportion(spark):
    rows = [(i, "good good" if i % 2 else "bad bad") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample(frame, frame.where("doc_id % 2 = 1 and doc_id < 400").select("doc_id"), 0.25, per_word=True).toPandas()
    good, bad = (got[got.doc_id % 2 == x] for x in (1, 0))
    assert got.kept.sum() == 1000 and good.kept.sum() > 3 * bad.kept.sum() > 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id")
    got = resample(spark.read.parquet(f"{sf}/documents.parquet"), good, 0.8)
    seen = got.join(labels.where(held_out(F.col("doc_id"))), "doc_id").toPandas()
    assert seen[seen.quality == 1].kept.mean() > 0.85 and seen[seen.quality == 0].kept.mean() < 0.05


def test_pipeline_by_hand(spark, tmp_path, monkeypatch):
    """Every stage's output against a plain version of it over its own input."""
    sf = tmp_path / "sf"
    docs, rows = documents(spark)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).selectExpr(
        "c0 as doc_id", "c1 || if(c0 % 10 in (0, 2, 8), ' db_password = \"hT9$kL2!vQ8z\"', '') as text", "c2 as lang",
        "c3 as source", "cast(length(c1) as long) as n_chars", "c9 as extra")
    plain.coalesce(2).write.parquet(f"{sf}/documents.parquet")
    long = next(r[1] for r in rows if r[0] == 12)
    items = [(1, " ".join(long.split()[:14])), (2, "word5 and5 word6")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    seen = {}
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        def watched(s, d, sf_dir, name=name, stage=stage):
            out = stage(s, d, sf_dir)
            if name != "packing":
                assert out.columns == d.columns
            seen[name] = d.collect()
            return out
        stages.append((name, watched))
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    packed = corpus_pipeline.run(spark, str(sf)).collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    key = lambda r: (r.doc_id, r.text)

    first = plain.collect()
    model = learn_languages(training_rows(plain))
    found = identify(plain, model).collect()
    want = Counter(key(r) for r in found if r.lang_pred != "und" and r.lang_score >= 0.2)
    assert Counter(map(key, first)) == Counter(map(key, seen[names[0]])) and Counter(map(key, seen[names[1]])) == want

    here = seen[names[1]]
    prints = [_fingerprint_by_hand(r.text) for r in here]
    root = roots(len(here), [(i, j) for i in range(len(here)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    groups = defaultdict(list)
    for i, r in enumerate(here):
        groups[root[i]].append(r)
    best = []
    for g in groups.values():
        with_id = [r for r in g if r.doc_id is not None]
        best.append(min(with_id, key=lambda r: r.doc_id).doc_id if with_id else None)
    assert sorted(map(str, best)) == sorted(str(r.doc_id) for r in seen[names[2]])

    after = {key(r) for r in seen[names[3]]}
    for r in seen[names[2]]:
        if by_hand(r.text, items, 10)[1] == 0:
            assert key(r) in after
    assert all(by_hand(r.text, items, 10)[1] == 0 and r.n_chars == len(r.text) for r in seen[names[3]])

    want = Counter((r.doc_id, redacted(r.text, find_spans(r.text, 0.45), "<secret>")) for r in seen[names[3]])
    assert Counter(map(key, seen[names[4]])) == want
    assert any("<secret>" in r.text for r in seen[names[4]])

    encode = encoder(tokenizer_path())
    assert sum(r.length for r in packed) == sum(len(encode(r.text)) + 1 for r in seen[names[4]])


def test_pipeline_of_nothing(spark, tmp_path):
    empty_documents(spark).drop("Text").selectExpr("doc_id", "cast(null as string) as text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
