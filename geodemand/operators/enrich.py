"""Area enrichment: constant lookups, dirty numeric text, shares, chained key joins, key caches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMERIC_RE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def map_constant(spark: SparkSession, df: DataFrame, col: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Dictionary lookup; unmatched values (and NULL) give NULL.

    The dictionary is a constant of the program, so its size is known when the
    plan is built: it becomes a small DataFrame joined with a broadcast hint.
    """
    lut = spark.createDataFrame(list(mapping.items()), f"_k string, {out} string")
    return df.join(F.broadcast(lut), df[col] == lut["_k"], "left").drop("_k")


def to_number(c) -> Column:
    """Text -> double when it is a plain decimal number; markers such as '-', 'N', '250,000+' -> NULL.

    The regex guard keeps Spark from accepting forms like '1d' that ``try_cast`` allows.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(NUMERIC_RE), F.trim(c).try_cast("double"))


def drop_label_rows(df: DataFrame, id_col: str, id_pattern: str) -> DataFrame:
    """Remove a second header line (human labels) by a predicate on the id column."""
    return df.where(F.col(id_col).rlike(id_pattern))


def shares(df: DataFrame, total: str, parts: Mapping[str, str]) -> DataFrame:
    """Each part divided by one total; division by zero or NULL -> NULL."""
    return df.withColumns({out: F.try_divide(F.col(p), F.col(total)) for out, p in parts.items()})


def enrich_two_hop(entities: DataFrame, key_map: DataFrame, area_map: DataFrame, measures: DataFrame,
                   entity_key: str, mid_key: str, area_key: str) -> DataFrame:
    """entity -> mid key (cache, 'None' text -> NULL) -> area -> measure, all left joins."""
    km = key_map.withColumn(mid_key, F.nullif(F.col(mid_key), F.lit("None")))
    return (entities.join(km, entity_key, "left")
            .join(area_map, mid_key, "left")
            .join(measures, area_key, "left"))


def upsert_keys(cache: DataFrame, ids: DataFrame, resolver, id_col: str) -> DataFrame:
    """Resolve only ids absent from the cache and append them (new version of the cache)."""
    todo = ids.select(id_col).distinct().join(cache.select(id_col), id_col, "left_anti")
    return cache.unionByName(resolver(todo), allowMissingColumns=True)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Whole-stage sink: overwrite a versioned Parquet folder (never the folder being read)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def replace_stage_columns(base: DataFrame, stage: DataFrame, key: str, stage_cols: Sequence[str]) -> DataFrame:
    """Idempotent re-run of an enrichment stage: drop its columns if present, then left-join fresh values."""
    present = [c for c in stage_cols if c in base.columns]
    return base.drop(*present).join(stage.select(key, *stage_cols), key, "left")
