"""Incremental key resolution as a Structured Streaming job over a versioned cache.

New ids arrive as files; each micro-batch resolves only ids that are not in
the cache yet and appends them. Every batch writes its own folder
(``batch=<id>``) in overwrite mode and looks up earlier batches only, so a batch
replayed after a failure resolves its ids again and replaces its own output; the
stream's progress lives in the checkpoint location (use the shared checkpoint
folder on a cluster). A cache belongs to one checkpoint location.

Every ``compact_every`` batches all rows so far are written as a snapshot, one
partition for each bucket of ids, and then entered in the manifest beside it. From
there on a batch reads the last snapshot entered -- the buckets of its own ids
alone -- and the batches since. A snapshot that was not finished is not in the
manifest, and the batch that writes it is run again with the same result.
Files of former batches and snapshots stay until the owner removes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder; one not written yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _beside(cache_path: str, name: str) -> str:
    return f"{cache_path.rstrip('/')}-{name}"


def _bucket(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")


def last_snapshot(spark: SparkSession, cache_path: str, before: int | None = None) -> tuple[int, int] | None:
    """(batch, buckets) of the last snapshot in the manifest, or of the last one before a batch."""
    manifest = _read(spark, _beside(cache_path, "manifest"), "buckets int, version long")
    if before is not None:
        manifest = manifest.where(F.col("version") < before)
    last = manifest.agg(F.max(F.struct("version", "buckets"))).first()[0]
    return None if last is None else (last["version"], last["buckets"])


def read_cache(spark: SparkSession, cache_path: str, schema: str, before: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """All rows of the cache, or those of the batches before one; a cache not written yet is empty.

    With ``ids`` (one column, the cache's key) only the buckets of the snapshot that can hold these are
    read; rows of other keys may come along.
    """
    snapshot = last_snapshot(spark, cache_path, before)
    batches = _read(spark, cache_path, f"{schema}, batch long")
    if before is not None:
        batches = batches.where(F.col("batch") < before)
    if snapshot is None:
        return batches.drop("batch")
    version, buckets = snapshot
    rows = spark.read.schema(f"{schema}, bucket int").parquet(f"{_beside(cache_path, 'snapshots')}/version={version}")
    if ids is not None:  # at most ``buckets`` numbers
        wanted = [r[0] for r in ids.select(_bucket(ids.columns[0], buckets)).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(wanted))
    return rows.drop("bucket").unionByName(batches.where(F.col("batch") > version).drop("batch"))


def write_snapshot(spark: SparkSession, cache_path: str, schema: str, id_col: str, version: int, buckets: int) -> None:
    """Write the rows of all batches up to ``version`` by buckets of the id, then enter the snapshot in the manifest."""
    rows = read_cache(spark, cache_path, schema, before=version).unionByName(
        _read(spark, f"{cache_path.rstrip('/')}/batch={version}", schema))
    by_bucket = rows.withColumn("bucket", _bucket(id_col, buckets)).repartition(buckets, "bucket")
    by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{_beside(cache_path, 'snapshots')}/version={version}")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(
        f"{_beside(cache_path, 'manifest')}/version={version}")


def start_key_cache_stream(spark: SparkSession, source_dir: str, source_schema: str, id_col: str,
                           cache_path: str, cache_schema: str, resolver: Callable[[DataFrame], DataFrame],
                           checkpoint_location: str, available_now: bool = True, compact_every: int = 64,
                           buckets: int = 64) -> StreamingQuery:
    """Start the stream; ``resolver(ids_df) -> DataFrame`` must return rows with ``cache_schema`` columns, the id among them.

    Null ids are left out. ``buckets`` may differ between runs: the manifest keeps each snapshot's own.
    """
    src = spark.readStream.schema(source_schema).parquet(source_dir)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select(id_col).where(batch[id_col].isNotNull()).distinct().persist()
        try:
            cache = read_cache(spark, cache_path, cache_schema, before=batch_id, ids=ids)
            todo = ids.join(cache.select(id_col), id_col, "left_anti")
            resolver(todo).write.mode("overwrite").parquet(f"{cache_path.rstrip('/')}/batch={batch_id}")
        finally:
            ids.unpersist()
        if (batch_id + 1) % compact_every == 0:
            write_snapshot(spark, cache_path, cache_schema, id_col, batch_id, buckets)

    w = src.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
