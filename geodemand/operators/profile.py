"""Data profiling: column summaries, missing rates, correlations, histograms, duplicate keys, coverage.

Each profile is one aggregation job over the whole table (wide ``agg`` then
``stack`` to long form), never a loop of jobs per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geodemand.operators.quantiles import exact_quantiles_multi


def _long(row_df: DataFrame, names: Sequence[str], measures: Sequence[str], key: str = "column_name") -> DataFrame:
    """Wide one-row result with columns <name>__<measure> -> one row per name."""
    parts = []
    for n in names:
        parts.append(F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{m}").alias(m) for m in measures]))
    return row_df.select(F.explode(F.array(*parts)).alias("_r")).select("_r.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value as text, n) of every column's non-null values, in one aggregation."""
    def text(c: str) -> Column:
        kind = df.schema[c].dataType
        x = F.col(c) + F.lit(0.0) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(c)  # -0.0 is 0.0
        return F.struct(F.lit(c).alias("column_name"), x.cast("string").alias("value"))

    long = df.select(F.explode(F.array(*[text(c) for c in columns])).alias("_r")).select("_r.*")
    return long.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summary of columns of any type: count and distinct count; mean, sample std, min, exact quartiles and max of
    numeric columns; the most frequent value (the smallest of equals) and its count for the others.

    Distinct counts and tops come from one partial count per (column, value), so
    no distinct aggregate expands the rows.
    """
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    aggs = []
    for c in columns:
        x = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        aggs += [F.count(F.col(c)).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    quartiles = exact_quantiles_multi(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}
    wide = df.agg(*aggs).withColumns({f"{c}__q": F.array(*[F.lit(v).cast("double") for v in quartiles.get(c, [None] * 3)])
                                      for c in columns})
    long = _long(wide, columns, ["count", "mean", "std", "min", "q", "max"])
    best = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value")))
    tops = value_counts(df, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("unique"), best.alias("_b"))
    text = ~F.col("column_name").isin(numeric) if numeric else F.lit(True)
    return long.join(tops, "column_name", "left").select(
        "column_name", "count", F.coalesce("unique", F.lit(0)).alias("unique"), F.when(text, F.col("_b.value")).alias("top"),
        F.when(text, F.col("_b.n")).alias("freq"), "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"), "max")


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULL values per column, highest first, then by name."""
    aggs = [F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__rate") for c in columns]
    rates = _long(df.agg(*aggs), columns, ["rate"]).withColumnRenamed("rate", "missing_rate")
    return rates.orderBy(F.col("missing_rate").desc(), "column_name")


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return df.agg(F.sum(cond.cast("int")).cast("bigint").alias("n_complete"), F.count(F.lit(1)).alias("n_rows"))


def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each feature with the target over pairwise-complete rows, strongest first."""
    aggs = [F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f"{f}__corr") for f in features]
    return _long(df.agg(*aggs), features, ["corr"], key="feature").orderBy(F.abs("corr").desc_nulls_last(), "feature")


def histogram(df: DataFrame, column: str, bins: int, log: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), empty bins included; optionally of log1p(value)."""
    x = F.log1p(F.col(column)) if log else F.col(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo_edge double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo_edge"),
                                                    F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
