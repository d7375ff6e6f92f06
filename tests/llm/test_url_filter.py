"""URL rules and the character models against plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geodemand.llm.common import pick
from geodemand.llm.queries import URL_RULES, op12_url_filter
from geodemand.llm.url_filter import ORDER, Rule, calibrate, judge_urls, windows

SCHEMA = "page_id long, url string, html string, Url string, host string, path string, rid long, w long, allow string"


def table(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "clash", "h", "p", 1, 2, "x") for i, u in enumerate(urls)], SCHEMA)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[:min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]


def rule_of(url, rules):
    host, path = parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


class Model:
    """Witten-Bell over all orders, by dictionaries."""

    def __init__(self, texts):
        self.grams = [Counter() for _ in range(ORDER + 1)]
        for t in texts:
            for context, byte in self.places(t):
                for k in range(ORDER + 1):
                    self.grams[k][context[ORDER - k:] + bytes([byte])] += 1
        self.follow = [defaultdict(Counter) for _ in range(ORDER + 1)]
        for k, grams in enumerate(self.grams):
            for g, n in grams.items():
                self.follow[k][g[:-1]][g[-1]] += n

    @staticmethod
    def places(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()) + b"\xff"
        raw = b"\xff" * ORDER + raw
        return [(raw[i - ORDER:i], raw[i]) for i in range(ORDER, len(raw))]

    def chance(self, context, byte):
        p = 1 / 256
        for k in range(ORDER + 1):
            after = self.follow[k].get(context[ORDER - k:])
            if after:
                p = (after[byte] + len(after) * p) / (sum(after.values()) + len(after))
        return p


def tail(url):
    return "" if url is None else url.split("://", 1)[-1]


def brute(spark, urls, rules):
    held = [r.h for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, url string").orderBy("i").select(
        (F.pmod(F.xxhash64("url"), F.lit(3)) == 0).alias("h")).collect()]
    rule = [rule_of(u, rules) for u in urls]
    of = lambda allow, fold: Model([tail(u) for u, r, h in zip(urls, rule, held, strict=True) if r and r.allow == allow and not (fold and h)])
    models = {fold: (of(True, fold), of(False, fold)) for fold in (True, False)}
    some = any(r and r.allow for r in rule) and any(r and not r.allow for r in rule)

    def score(url, fold):
        a, b = models[fold]
        places = Model.places(tail(url))
        return sum(math.log(a.chance(*p)) - math.log(b.chance(*p)) for p in places) / len(places) if some else 0.0

    bins = defaultdict(lambda: [0, 0])
    for u, r, h in zip(urls, rule, held, strict=True):
        if r and h:
            bins[max(-4096, min(4096, math.floor(score(u, True) * 256)))][0 if r.allow else 1] += 1
    keys = sorted(bins)
    slope, offset = calibrate(*(np.array(v, dtype=float) for v in (keys, [bins[k][0] for k in keys], [bins[k][1] for k in keys])))
    out = []
    for u, r in zip(urls, rule, strict=True):
        if r:
            out.append((*parts(u), r.host + r.path, r.allow, None, None))
        else:
            s = score(u, False)
            c = 1 / (1 + math.exp(-(slope * s + offset)))
            out.append((*parts(u), None, c >= 0.5, s, c))
    return out


def check(spark, urls, rules):
    got = {r.page_id: r for r in judge_urls(table(spark, urls), rules).collect()}
    assert len(got) == len(urls)
    for i, (host, path, rule, allow, score, chance) in enumerate(brute(spark, urls, rules)):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[i]
        if score is None:
            assert r.score is None and r.chance is None
        else:
            assert abs(r.score - score) < 1e-9 and abs(r.chance - chance) < 1e-9
        if score is None or abs(chance - 0.5) > 1e-9:
            assert r.verdict == ("allow" if allow else "block"), urls[i]
    return got


def sample(n, seed):
    rng = random.Random(seed)
    words = ["tion", "the", "ther", "casino", "pills", "news", "größe", "ß", "Blog"]
    return [f"http{'s' * rng.randrange(2)}://{rng.choice(['www.', 'm.', ''])}{rng.choice(words)}{rng.choice(words)}.{rng.choice(['example.com', 'example.org', 'Example.NET', 'x.org'])}"
            f"/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(3000)}{rng.choice(['', '/', '?a=b/c', '#top', '.html'])}" for _ in range(n)]


ODD = [None, "", "no scheme/here", "http://", "://", "a://b://c/d", "http://org", "http://org/", "http://ORG/x", "https://notorg/x", "https://a.org?x=/", "x://é.com/fr/ü",
       "https://com/de/", "http://example.org/en/1", "http://sub.example.org/en/12", "http://example.org/en/2", "http://a.b\n.com/fr/\nz", "http://example.org/ES/", "http://h:80/p"]


def test_against_dictionaries(spark):
    urls = sample(300, 1)
    check(spark, urls + ODD + urls[:40] + [urls[0]] * 150, URL_RULES)  # a third of the rows is one URL


def test_without_examples_of_a_class(spark):
    urls = sample(30, 2)
    for rules in ([], [Rule(True, "org", "/")], [Rule(False, "org", "/")]):
        got = check(spark, urls + ODD, rules)
        assert all(r.verdict == "allow" for r in got.values() if r.rule is None)


def test_longest_rule_and_ties(spark):
    rules = [Rule(True, "com", "/a"), Rule(False, "b.com", "/"), Rule(True, "c.b.com", "/"), Rule(False, "com", "/a")]
    got = judge_urls(table(spark, ["x://q.com/ab", "x://b.com/ab", "x://c.b.com/z", "x://xb.com/ab"]), rules).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("com/a", "allow"), ("b.com/", "block"), ("c.b.com/", "allow"), ("com/a", "allow")]


def test_long_urls_are_whole(spark):
    rng = random.Random(3)
    long = "https://q.net/" + "".join(rng.choice("abcdé/") for _ in range(1_500_000))
    urls = [*sample(60, 4), long]
    got = judge_urls(table(spark, urls), URL_RULES).where("page_id = 60").first()
    a, b = (Model([tail(u) for u in urls if (r := rule_of(u, URL_RULES)) and r.allow == allow]) for allow in (True, False))
    places = Model.places(tail(long))
    known = {p: math.log(a.chance(*p)) - math.log(b.chance(*p)) for p in set(places)}
    assert abs(got.score - sum(known[p] for p in places) / len(places)) < 1e-9


def test_windows_of_rows():
    texts = ["Ab", "", "xyz"]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    row, code = windows(raw, np.array([0, 2, 2, 5]))
    want = [(i, int.from_bytes(c + bytes([b]), "big")) for i, t in enumerate(texts) for c, b in Model.places(t)]
    assert list(zip(row.tolist(), code.tolist(), strict=True)) == want


def test_calibration_recovers_a_curve():
    bins = np.arange(-1024, 1025, 16).astype(float)
    p = 1 / (1 + np.exp(-(2.0 * (bins + 0.5) / 256 - 1.0)))
    slope, offset = calibrate(bins, p * 1e6, (1 - p) * 1e6)
    odds = math.log((p * 1e6).sum() / ((1 - p) * 1e6).sum())
    assert slope == pytest.approx(2.0, abs=1e-3) and offset == pytest.approx(-1.0 - odds, abs=1e-3)
    assert calibrate(bins, bins * 0, bins * 0 + 1) == (1.0, 0.0)


def test_models_tell_languages_apart_and_empty_table(spark, tmp_path):
    rng = random.Random(5)
    urls = [f"https://{''.join(rng.choice('abcdefgh') for _ in range(8))}.{rng.choice(['com', 'net'])}/{rng.choice(['fr', 'de'])}/{rng.randrange(9999)}" for _ in range(900)]
    got = judge_urls(table(spark, urls), URL_RULES).where("rule is null").collect()
    right = [r.verdict == ("allow" if r.path.startswith("/fr/") else "block") for r in got]
    assert sum(right) / len(right) > 0.98
    assert judge_urls(spark.createDataFrame([], SCHEMA), URL_RULES).collect() == []
    pick(table(spark, urls[:50]), page_id="page_id", url="url", html="html").write.parquet(str(tmp_path / "pages.parquet"))
    assert op12_url_filter(spark, str(tmp_path)).count() == 50
