"""Incremental key cache stream: only unseen ids are resolved; replays do not duplicate."""

import os
import re
import shutil
import tempfile

from pyspark.sql import functions as F

from geodemand.streaming.key_cache import last_snapshot, read_cache, start_key_cache_stream, write_snapshot


def test_incremental_resolution(spark):
    base = tempfile.mkdtemp(prefix="geodemand-stream-", dir="/tmp")
    src, cache, ckpt = (os.path.join(base, x) for x in ("src", "cache", "ckpt"))
    calls = []

    def resolver(ids):
        calls.append(1)
        return ids.select("code", F.lpad(F.col("code").cast("string"), 5, "0").alias("county_fips"))

    spark.createDataFrame([(1,), (2,), (2,)], "code long").write.parquet(os.path.join(src, "part1"))
    args = (spark, src + "/*", "code long", "code", cache, "code long, county_fips string", resolver, ckpt)
    start_key_cache_stream(*args).awaitTermination(120)
    spark.createDataFrame([(2,), (3,)], "code long").write.parquet(os.path.join(src, "part2"))
    start_key_cache_stream(*args).awaitTermination(120)
    rows = sorted((r.code, r.county_fips) for r in read_cache(spark, cache, "code long, county_fips string").collect())
    assert rows == [(1, "00001"), (2, "00002"), (3, "00003")]


def test_compaction_bounds_the_files_read(spark):
    """Seven batches, a snapshot every three: the same rows, few files, and a lost snapshot entry changes nothing."""
    base = tempfile.mkdtemp(prefix="geodemand-compact-", dir="/tmp")
    src, cache, ckpt = (os.path.join(base, x) for x in ("src", "cache", "ckpt"))
    schema = "code long, county_fips string"
    asked = []

    def resolver(ids):
        asked.extend(r.code for r in ids.collect())
        return ids.select("code", F.lpad(F.col("code").cast("string"), 5, "0").alias("county_fips")).coalesce(1)

    args = (spark, src + "/*", "code long", "code", cache, schema, resolver, ckpt)
    for k in range(7):
        spark.createDataFrame([(i,) for i in range(3 * k, 3 * k + 5)] + [(None,), (0,)], "code long").coalesce(1).write.parquet(f"{src}/part{k}")
        start_key_cache_stream(*args, compact_every=3, buckets=4).awaitTermination(120)
    assert last_snapshot(spark, cache) == (5, 4) and last_snapshot(spark, cache, before=5) == (2, 4)
    assert last_snapshot(spark, cache, before=2) is None
    want = [(i, f"{i:05d}") for i in range(23)]
    rows = read_cache(spark, cache, schema)
    assert sorted(map(tuple, rows.collect())) == want
    assert sorted(asked) == list(range(23))  # each id once
    assert rows.select(F.input_file_name()).distinct().count() <= 4 + 1
    plan = rows._jdf.queryExecution().executedPlan().toString()  # former batches are pruned as partitions, not row by row
    assert re.search(r"PartitionFilters: \[[^\]]*batch#\d+L > 5", plan), plan
    one = read_cache(spark, cache, schema, ids=spark.createDataFrame([(7,)], "code long"))
    assert (7, "00007") in set(map(tuple, one.collect())) and one.count() < 23
    # the state before the fourth batch does not see later ones, so a batch run again finds what it found
    assert sorted(map(tuple, read_cache(spark, cache, schema, before=4).collect())) == want[:14]
    shutil.move(f"{cache}-manifest/version=5", f"{base}/entry5")  # a snapshot that was written but not entered
    assert last_snapshot(spark, cache) == (2, 4)
    assert sorted(map(tuple, read_cache(spark, cache, schema).collect())) == want
    write_snapshot(spark, cache, schema, "code", 5, 2)  # run again, with another number of buckets
    assert last_snapshot(spark, cache) == (5, 2)
    assert sorted(map(tuple, read_cache(spark, cache, schema).collect())) == want
