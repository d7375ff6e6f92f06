"""Fuzzy scores and the blocked similarity join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from geodemand.functions import text as N
from geodemand.operators import matching as M
from geodemand.operators.matching import _bigram_bound, similarity_join
from geodemand.plans import q_matching as QM
from geodemand.plans.fixtures import Fixtures
from tests import fuzzy_reference as T


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def test_lcs_bit_parallel_equals_dp():
    rnd = random.Random(7)
    for _ in range(500):
        a = "".join(rnd.choice("abc #1") for _ in range(rnd.randint(0, 90)))
        b = "".join(rnd.choice("abc #1") for _ in range(rnd.randint(0, 90)))
        assert T.lcs_length(a, b) == lcs_dp(a, b)


def test_native_scores_equal_the_plain_ones(spark):
    rnd = random.Random(5)
    sizes = [0, 1, 5, 20, 61, 62, 63, 64, 124, 125, 130, 200]
    text = lambda: "".join(rnd.choice("abc #1é\U0001f600") for _ in range(rnd.randint(0, rnd.choice(sizes))))
    rows = [(text(), text()) for _ in range(300)] + [("", ""), ("x", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", N.lcs_length("a", "b").alias("lcs"), N.indel_ratio("a", "b").alias("ratio"),
        N.token_sort_ratio("a", "b").alias("sort"), N.token_set_ratio("a", "b").alias("set")).collect()
    for r in got:
        if r.b is None:
            assert r.ratio is None and r["sort"] is None and r["set"] is None
            continue
        assert r.lcs == T.lcs_length(r.a, r.b)
        for have, want in ((r.ratio, T.indel_ratio), (r["sort"], T.token_sort_ratio), (r["set"], T.token_set_ratio)):
            assert have == pytest.approx(want(r.a, r.b), abs=1e-9)


def test_candidates_are_few(spark, monkeypatch):
    """Names that share their common words and most of their letters do not all meet."""
    rnd = random.Random(8)
    name = lambda i: f"{rnd.choice(['north', 'south', 'old', 'new'])} {''.join(rnd.choice('abcdefghijklmnop') for _ in range(7))} central {i:06d}"
    right = [name(i) for i in range(600)]
    left = [r.replace("central", "centrl") if i % 4 else name(10_000 + i) for i, r in enumerate(right)]
    scored = []
    candidates = M._candidates

    def counted(*args):
        pairs = candidates(*args).cache()
        scored.append(pairs.count())
        return pairs

    monkeypatch.setattr(M, "_candidates", counted)
    L = spark.createDataFrame(list(enumerate(left)), "lid int, lt string")
    R = spark.createDataFrame([(i, r) for i, r in enumerate(right * 2)], "rid int, rt string")
    for scorer, limit in (("token_sort", 85), ("token_set", 80)):
        scored.clear()
        got = {r.lid: r.rid for r in similarity_join(L, R, left_id="lid", left_text="lt", right_id="rid", right_text="rt",
                                                     threshold=limit, scorer=scorer).collect()}
        assert all(got[i] == i for i in range(600) if i % 4)
        assert sum(scored) < 0.1 * 600 * 600, (scorer, scored)


def test_token_set_pairs_are_pruned_before_they_meet(spark, monkeypatch):
    """Joined rows (repeats counted) of two-word names, with one many-word name more, and with a word common to all."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 9)))
    left, right = ([f"{word()} {word()}" for _ in range(300)] for _ in range(2))
    right[7] = left[11][:-1] + "#"
    met = []
    by_words = M._by_words

    def counted(*args):
        pairs = by_words(*args).cache()
        met.append(pairs.count())
        return pairs

    def joined(lt, rt):
        met.clear()
        got = {r.lid: (r.rid, r.score) for r in similarity_join(
            spark.createDataFrame(list(enumerate(lt)), "lid int, lt string"), spark.createDataFrame(list(enumerate(rt)), "rid int, rt string"),
            left_id="lid", left_text="lt", right_id="rid", right_text="rt", threshold=80, scorer="token_set").collect()}
        assert got == _brute([(i, x, None) for i, x in enumerate(lt)], [(i, x, None) for i, x in enumerate(rt)], T.token_set_ratio, 80, False)
        return sum(met)

    monkeypatch.setattr(M, "_by_words", counted)
    plain = joined(left, right)
    assert plain < 0.1 * len(left) * len(right), plain
    long = " ".join(word() for _ in range(10))
    assert joined([*left, long], [*right, long + "x"]) < plain + 200
    common = joined([x.split()[0] + " central" for x in left], [x.split()[0] + " central" for x in right])
    assert common < 0.1 * len(left) * len(right), common


def test_known_scores():
    assert T.indel_ratio("new york", "york new") == pytest.approx(50.0)
    assert T.token_sort_ratio("new york", "york new") == 100.0
    assert T.token_set_ratio("albany", "albany ny") == 100.0
    assert T.token_set_ratio("", "x") == 0.0
    assert T.token_sort_ratio("a b", "b a") == T.token_sort_ratio("b a", "a b")


def test_bigram_bound_is_a_lower_bound():
    """Shared bigram occurrences >= bound whenever the Indel ratio reaches the threshold."""
    rnd = random.Random(3)
    for t in (0.8, 0.85, 0.9):
        for _ in range(3000):
            a = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14)))
            b = list(a)
            for _ in range(rnd.randint(0, 3)):
                op = rnd.random()
                if op < 0.5 and b:
                    b.pop(rnd.randrange(len(b)))
                else:
                    b.insert(rnd.randrange(len(b) + 1), rnd.choice("abcd"))
            b = "".join(b)
            if not b or T.indel_ratio(a, b) < 100 * t:
                continue
            from collections import Counter
            ga = Counter(a[i:i + 2] for i in range(len(a) - 1))
            gb = Counter(b[i:i + 2] for i in range(len(b) - 1))
            shared = sum((ga & gb).values())
            assert shared >= min(_bigram_bound(len(a), t), _bigram_bound(len(b), t)), (a, b, t)


def _brute(left, right, scorer, threshold, block):
    best = {}
    for lid, lt, lb in left:
        for rid, rt, rb in right:
            if block and (lb is None or lb != rb):
                continue
            s = scorer(lt, rt)
            if s >= threshold and (lid not in best or (-s, rid) < (-best[lid][1], best[lid][0])):
                best[lid] = (rid, s)
    return best


def test_fuzzy_in_block_equals_brute_force(spark, sf_small):
    fx = Fixtures(spark, sf_small)
    o = QM.obs_names(fx.obs()).select("obs_id", "city_norm", "state")
    s = QM.site_names(fx.sites()).select("site_id", "city_norm", "state")
    got = {r.obs_id: (r.site_id, r.score) for r in QM.fuzzy_in_block(o, s).collect()}
    exp = _brute([tuple(r) for r in o.collect()], [tuple(r) for r in s.collect()], T.token_sort_ratio, 85, True)
    assert got == exp


def test_fuzzy_global_equals_brute_force(spark, sf_small):
    fx = Fixtures(spark, sf_small)
    stops = fx.obs_gaps().select("obs_id", N.clean_stop_name("raw_name").alias("clean_name"))
    sites = fx.sites().select("site_id", "name")
    got = {r.obs_id: (r.site_id, r.score) for r in QM.fuzzy_global(stops, sites).collect()}
    exp = _brute([(r[0], r[1], None) for r in stops.collect()], [(r[0], r[1], None) for r in sites.collect()],
                 T.token_set_ratio, 80, False)
    assert got == exp


def test_short_strings_and_random_text(spark):
    rnd = random.Random(11)
    words = ["ab", "a", "b", "abc", "ba", "", "xyz", "abd", "aab"]
    left = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3)))) for i in range(120)]
    right = [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3)))) for i in range(60)]
    L = spark.createDataFrame(left, "lid long, lt string")
    R = spark.createDataFrame(right, "rid long, rt string")
    for scorer, fn, th in (("token_sort", T.token_sort_ratio, 70), ("token_set", T.token_set_ratio, 80),
                           ("ratio", T.indel_ratio, 60)):
        got = {r.lid: (r.rid, r.score) for r in similarity_join(
            L, R, left_id="lid", left_text="lt", right_id="rid", right_text="rt", threshold=th,
            scorer=scorer).collect()}
        exp = _brute([(a, b, None) for a, b in left], [(a, b, None) for a, b in right], fn, th, False)
        assert got == exp, scorer


def test_cascade_covers_every_row_once(spark, sf_small):
    fx = Fixtures(spark, sf_small)
    c = QM.observation_cascade(spark, fx, fx.obs_gaps())
    assert c.count() == fx.obs_gaps().count()
    assert c.select("obs_id").distinct().count() == c.count()
    methods = {r[0] for r in c.select(F.regexp_extract("match_method", r"^([a-z_]+)", 1)).distinct().collect()}
    assert methods <= {"override", "no_state_candidates", "coord", "fuzzy", "unmatched"}


def test_numbered_names_meet_few(spark, monkeypatch):
    """Names of one form that differ in their digits meet those with nearly all digits in the same order only."""
    right = [f"#{i:09d} supplier" for i in range(0, 4000, 4)]
    left = [f"#{i:09d} supplier" for i in range(1, 1200, 4)]
    met = []
    by_grams = M._by_grams

    def counted(*args):
        pairs = by_grams(*args).cache()
        met.append(pairs.distinct().count())
        return pairs

    monkeypatch.setattr(M, "_by_grams", counted)
    got = {r.lid: (r.rid, r.score) for r in similarity_join(
        spark.createDataFrame(list(enumerate(left)), "lid int, lt string"), spark.createDataFrame(list(enumerate(right)), "rid int, rt string"),
        left_id="lid", left_text="lt", right_id="rid", right_text="rt", threshold=85).collect()}
    assert got == _brute([(i, x, None) for i, x in enumerate(left)], [(i, x, None) for i, x in enumerate(right)], T.token_sort_ratio, 85, False)
    assert sum(met) < 0.02 * len(left) * len(right), met


def test_work_on_small_tables_is_spread(spark):
    """Packed forms fill few bytes but much memory: they are in as many partitions as the session shuffles to, and joined without a broadcast."""
    forms = spark.createDataFrame([("L", 0, "ab cd"), ("R", 0, "ab ce")], "_side string, _blk int, _form string")
    arrays = M._token_arrays(forms, False)
    assert arrays.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = arrays._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_side" in plan and "BroadcastHashJoin [_side" not in plan
