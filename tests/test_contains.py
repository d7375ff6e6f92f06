"""Containment by the automaton against Python's ``in``."""

import random

import pytest
from pyspark.sql import functions as F

from geodemand.operators.contains import contains_first


def brute(patterns, titles):
    out = {}
    for p, st in set(patterns):
        fits = [(o, k) for k, o, t in titles if p and t is not None and p in t and (st == "" or st in t)]
        if fits:
            out[p, st] = min(fits)[1]
    return out


def check(spark, patterns, titles, **options):
    p = spark.createDataFrame(patterns, "p string, st string")
    t = spark.createDataFrame(titles, "k string, o int, t string")
    extra = (F.col("st") == "") | (F.instr("t", F.col("st")) > 0)
    found = contains_first(p, t, pattern="p", title="t", title_key="k", title_order="o", extra=extra, **options)
    assert found.columns == ["p", "st", "k"]
    assert {(r.p, r.st): r.k for r in found.collect()} == brute(patterns, titles)
    return found


@pytest.mark.parametrize("per_block", [3, 100_000])
def test_against_python(spark, per_block):
    rng = random.Random(per_block)
    word = lambda n: "".join(rng.choice("abß€ ") for _ in range(n))
    titles = [(f"k{i % 180}", rng.randrange(40), word(rng.randrange(0, 14))) for i in range(200)] + [("n", 0, None), ("e", 0, "")]
    patterns = [(word(rng.randrange(1, 6)), rng.choice(["", "", "a", "zz"])) for _ in range(60)]
    patterns += [("a", ""), ("ab", ""), ("€", ""), ("", ""), (None, ""), patterns[0], patterns[0], ("ab", "a")]
    check(spark, [p for p in patterns if p[0] is not None], titles, per_block=per_block)
    p = spark.createDataFrame(patterns, "p string, st string")
    t = spark.createDataFrame(titles, "k string, o int, t string")
    plain = contains_first(p, t, pattern="p", title="t", title_key="k", title_order="o", per_block=per_block)
    assert plain.where("p is null or p = ''").count() == 0


def test_nothing_to_find(spark):
    check(spark, [("x", "")], [("k", 1, "abc")])
    check(spark, [("", "")], [("k", 1, "abc")])
    t = spark.createDataFrame([("k", 1, "abc")], "k string, o int, t string")
    p = spark.createDataFrame([("a", "")], "p string, st string")
    for left, right in ((p.limit(0), t), (p, t.limit(0))):
        assert contains_first(left, right, pattern="p", title="t", title_key="k", title_order="o").collect() == []


def test_no_title_is_taken_apart(spark):
    found = check(spark, [("ab", ""), ("b", "")], [("k", 1, "xab"), ("m", 0, "b")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
