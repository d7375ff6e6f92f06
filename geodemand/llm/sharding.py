"""Sharding: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geodemand.llm.common import pick, prepare


def least_loaded(sizes: list[tuple[int, str]], n_shards: int) -> dict[str, int]:
    """Largest size first, each to the least-loaded shard (ties: lowest shard, smallest key)."""
    heap = [(0, shard) for shard in range(n_shards)]
    out = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[key] = shard
    return out


def assign_shards(docs: DataFrame, n_shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text",
                  row_overhead: int = 8, units_per_shard: int = 1024, slot_block: int = 4096) -> DataFrame:
    """Shards of nearly equal bytes; rows with equal texts share a shard.

    A row weighs its UTF-8 bytes plus ``row_overhead``. Equal texts form a
    group. With ``quantum = total / (n_shards * units_per_shard)``, a group of a
    quantum or more is a unit of its own and the smaller ones are pooled by text
    digest into ``n_shards * units_per_shard`` units, so the driver's heap holds
    at most ``2 * n_shards * units_per_shard`` units at any input size and the
    shards differ by about one pooled unit (unless one group alone outweighs a
    shard, which cannot be split). Texts are read once and never shuffled; a hot
    text is summed before the shuffle.

    Null text weighs as, and goes with, the empty text. Null ids and repeated
    rows each get a slot. An empty table gives an empty result. Other columns
    are ignored. Returns id, size, text_crc32, law ``bytes``, shard, slot
    (gapless from 0 in each shard) and a null ``grown_shard``.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    digest = F.md5(raw)
    units = n_shards * units_per_shard
    thin = pick(docs, id=id_col, text=text_col).select(
        "id", (F.octet_length(text) + F.lit(row_overhead)).cast("long").alias("size"),
        F.crc32(raw).alias("crc"), digest.alias("grp"),
    ).checkpoint()
    pool = F.concat(F.lit("p"), F.pmod(F.xxhash64("grp"), F.lit(units)).cast("string"))
    total, n = thin.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    quantum = max(1, -(-total // units))
    sums = thin.groupBy("grp").agg(F.sum("size").alias("bytes"))
    sums = sums.select(F.when(F.col("bytes") >= quantum, F.col("grp")).otherwise(pool).alias("unit"), "bytes")
    found = sums.groupBy("unit").agg(F.sum("bytes").alias("bytes")).toArrow()
    plan = least_loaded(list(zip(found["bytes"].to_pylist(), found["unit"].to_pylist())), n_shards)
    table = pa.table({"unit": pa.array(list(plan), pa.string()), "to": pa.array(list(plan.values()), pa.int32())})
    # at most 2 * units rows, whatever the input
    owners = F.broadcast(spark.createDataFrame(table))
    own = owners.select(F.col("unit").alias("grp"), F.col("to").alias("own"))
    placed = (thin.withColumn("unit", pool)
              .join(own, "grp", "left")
              .join(owners, "unit", "left")
              .select("id", "size", "crc", F.coalesce("own", "to").alias("shard")))
    blocks = max(1, n // (n_shards * slot_block))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(blocks)))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "block").orderBy("id", "crc", "size")
    return (placed.withColumn("at", F.row_number().over(within) - 1)
            .join(counts, ["shard", "block"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
                    F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("base") + F.col("at")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
