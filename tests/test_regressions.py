"""Cases that once changed data silently: large values, missing order keys, missing ends, replayed batches."""

import os
import shutil
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from geodemand.functions.geo import round6, round_to, round_to_sql
from geodemand.operators import report as RP
from geodemand.operators.rows import first_non_null, keep_first, with_row_index
from geodemand.session import ensure_checkpoint_dir
from geodemand.streaming.key_cache import read_cache, start_key_cache_stream

VALUES = [0.0, 1.2345675, -1.2345675, 9.1e9, 1e13, -1e13, 9.3e18, 1e300, float("inf"), float("nan"), None]


@pytest.mark.parametrize("digits", [1, 3, 6])
def test_rounding_keeps_large_values(spark, digits):
    got = [r[0] for r in spark.createDataFrame([(v,) for v in VALUES], "x double").select(round_to("x", digits)).collect()]
    lit = ", ".join("(null)" if v is None else f"('{v!r}'::double)" for v in VALUES)
    want = [r[0] for r in duckdb.sql(f"select {round_to_sql('x', digits)} from (values {lit}) t(x)").fetchall()]
    assert [repr(v) for v in got] == [repr(v) for v in want]
    assert got[4:8] == VALUES[4:8]
    assert spark.range(1).select(round6(F.lit(10**13))).first()[0] == 1e13


def test_missing_keys_come_last(spark):
    rows = [("a", None, 1), ("a", 5, 2), ("a", 7, 3), ("b", None, 4)]
    df = spark.createDataFrame(rows, "k string, w long, v int")
    pick = lambda asc: {r.k: r.v for r in keep_first(df, ["k"], [("w", asc), ("v", True)]).collect()}
    assert pick(False) == {"a": 3, "b": 4} and pick(True) == {"a": 2, "b": 4}
    extremes = spark.createDataFrame([("a", -2**63, 1), ("a", 2**63 - 1, 2)], "k string, w long, v int")
    assert keep_first(extremes, ["k"], [("w", False)]).first().v == 2


@pytest.mark.parametrize("kind,values", [("string", ["", "a", "ab", "é", "b", "aé"]), ("boolean", [True, False]),
                                         ("double", [-1.5, 0.0, 2.5]), ("string", ["x", "xy", "xyz", "x\U0001f600"])])
def test_descending_keys_of_any_type(spark, kind, values):
    df = spark.createDataFrame([(1, v) for v in values] + [(1, None)], f"k int, w {kind}")
    order = [("w", False)]
    best = keep_first(df.withColumn("v", F.col("w")), ["k"], order).first().v
    assert best == df.agg(F.max("w")).first()[0]
    assert first_non_null(df.withColumn("v", F.col("w")), ["k"], order, ["v"]).first().v == best


def test_row_index_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("_id0")).repartition(7)
    got = with_row_index(df, [("k", False)]).collect()
    assert sorted((r.row_idx, r.k) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert with_row_index(df.limit(0), [("k", True)]).count() == 0


def test_pairs_with_unknown_ends_stay_apart(spark):
    rows = [(1, 1, 10, 20, "X", None, 0.5), (1, 2, 10, 30, "X", None, 0.4), (1, 3, 20, 10, None, "X", 0.3), (1, 4, 30, 10, None, "X", None)]
    df = spark.createDataFrame(rows, "route_id int, seq int, from_stop long, to_stop long, from_name string, to_name string, score double")
    got = sorted((r.pair_a, r.pair_b, r.score) for r in RP.best_per_unordered_pair(df, ["route_id", "seq"]).collect())
    assert got == [("X", "stop 20", 0.3), ("X", "stop 30", 0.4)]


def test_unscored_stops_keep_their_names(spark):
    segs = spark.createDataFrame([(1, 1, 10, 20, 7)], "route_id int, seq int, from_stop long, to_stop long, trips long")
    lookup = spark.createDataFrame([(10, "Ten", 0.5, 9)], "stop_id long, name string, ratio double, actual long")
    stops = spark.createDataFrame([(10, "ten"), (20, "twenty")], "stop_id long, stop_name string")
    r = RP.score_segments(segs, lookup, stops).first()
    assert (r.from_name, r.to_name, r.from_r, r.to_r, r.score) == ("Ten", "twenty", 0.5, None, 0.5)


def test_snapping_restarts_after_a_gap(spark):
    line = spark.createDataFrame([(1, i, float(i % 4), 0.0) for i in range(8)], "route_id int, pt_seq int, pt_lat double, pt_lon double")
    stops = spark.createDataFrame([(1, 1, "a", 2.0, 0.0), (1, 2, "b", 1.0, 0.0), (1, 3, "c", None, 0.0), (1, 4, "d", 0.1, 0.0), (2, 1, "e", 0.0, 0.0)],
                                  "route_id int, seq int, stop_id string, lat double, lon double")
    got = sorted((r.route_id, r.seq, r.shape_idx) for r in RP.snap_monotone(stops, line).collect())
    assert got == [(1, 1, 2), (1, 2, 5), (1, 3, None), (1, 4, 0), (2, 1, None)]


def test_replayed_batch_loses_nothing(spark):
    base = tempfile.mkdtemp(prefix="geodemand-replay-", dir="/tmp")
    src, cache, ckpt = (os.path.join(base, x) for x in ("src", "cache", "ckpt"))
    schema = "code long, fips string"

    def resolver(ids):
        return ids.select("code", F.lpad(F.col("code").cast("string"), 5, "0").alias("fips"))

    args = (spark, src + "/*", "code long", "code", cache, schema, resolver, ckpt)
    spark.createDataFrame([(i,) for i in range(5)], "code long").write.parquet(f"{src}/part1")
    start_key_cache_stream(*args).awaitTermination(120)
    spark.createDataFrame([(4,), (5,)], "code long").write.parquet(f"{src}/part2")
    start_key_cache_stream(*args).awaitTermination(120)
    want = sorted(map(tuple, read_cache(spark, cache, schema).collect()))
    assert [c for c, _ in want] == [0, 1, 2, 3, 4, 5]
    shutil.move(f"{ckpt}/commits/1", f"{base}/commit1")  # the second batch's commit is lost: it runs again
    if os.path.exists(f"{ckpt}/commits/.1.crc"):
        shutil.move(f"{ckpt}/commits/.1.crc", f"{base}/commit1.crc")
    start_key_cache_stream(*args).awaitTermination(120)
    assert sorted(map(tuple, read_cache(spark, cache, schema).collect())) == want


def test_damaged_cache_is_no_empty_cache(spark):
    base = tempfile.mkdtemp(prefix="geodemand-cache-", dir="/tmp")
    assert read_cache(spark, f"{base}/none", "code long").count() == 0
    os.makedirs(f"{base}/bad/batch=0")
    with open(f"{base}/bad/batch=0/part.parquet", "w") as fh:
        fh.write("no parquet")
    with pytest.raises(Exception):
        read_cache(spark, f"{base}/bad", "code long").count()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
