"""Order-dependent row idioms made explicit: keep-first, top-k, first non-null per column.

Keep-first is an aggregation (``min_by`` over an explicit ordering struct), not a
``row_number`` window, so a key holding a third of all rows is reduced map-side
instead of being sorted inside one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geodemand.functions.text import chars


def _descending(name: str, kind: T.DataType) -> Column:
    """A key whose ascending order is the descending order of the column."""
    c = F.col(name)
    if isinstance(kind, T.StringType):
        # negated code points; the closing 1 is larger than each, so a prefix comes after the longer text
        return F.concat(F.transform(chars(c), lambda ch: -F.ascii(ch)), F.array(F.lit(1)))
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return -c.cast("decimal(20,0)")  # the smallest long has no negative
    return -c


def order_struct(df: DataFrame, order: Sequence[tuple[str, bool]]) -> Column:
    """Struct whose natural ascending order equals the requested order of ``df``'s columns.

    ``order`` is (column, ascending). NULL comes last in either direction, so a
    missing value never beats a present one.
    """
    parts = []
    for i, (c, asc) in enumerate(order):
        parts.append(F.col(c).isNull().alias(f"_n{i}"))
        parts.append((F.col(c) if asc else _descending(c, df.schema[c].dataType)).alias(f"_k{i}"))
    return F.struct(*parts)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as the session shuffles to, for small rows with much work on each.

    Partitions are else merged by the bytes that they hold, and a table of one file part stays in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """One row per key: the first under ``order`` (a total order must be given for determinism)."""
    cols = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in cols]), order_struct(df, order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def first_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]],
                   columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key; each column takes its first non-NULL value under ``order`` (not the first row's)."""
    cols = columns or [c for c in df.columns if c not in keys and c not in [o for o, _ in order]]
    ordk = order_struct(df, order)
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ordk)).alias(c) for c in cols]
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(*aggs)


def ordered_text(df: DataFrame, keys: Sequence[str], order: str, text: str, out: str, sep: str = " + ",
                 rows_per_range: int = 50_000) -> DataFrame:
    """Per key, the ``text`` of its rows joined by ``sep`` in the order of ``order`` (ties by text); NULL texts are left out.

    The rows are dealt to ranges of ``order`` of about ``rows_per_range`` rows.
    Each (key, range) is joined by itself and the parts are joined in the order of
    their ranges, so a key that holds a third of all rows is sorted in many tasks
    and only its finished parts meet. NULL keys are dropped; a key without any
    text has an empty one.
    """
    known = df.select(*keys, F.col(order).alias("_o"), F.col(text).alias("_t")).dropna(subset=list(keys))
    ranges = max(1, math.ceil(known.count() / rows_per_range))

    def joined(at: str, what: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda x: x[what]), sep)

    dealt = known.repartitionByRange(ranges, "_o").withColumn("_range", F.spark_partition_id())
    # a part without texts is NULL, so it adds no separator
    parts = dealt.groupBy(*keys, "_range").agg(F.when(F.count("_t") > 0, joined("_o", "_t")).alias("_part"))
    return parts.groupBy(*keys).agg(joined("_range", "_part").alias(out))


def top_k(df: DataFrame, k: int, order: Sequence[tuple[str, bool]], nulls_last: bool = True) -> DataFrame:
    """The first k rows under ``order``; NULL measures are dropped (pandas nlargest/nsmallest)."""
    d = df
    if nulls_last:
        for c, _ in order[:1]:
            d = d.where(F.col(c).isNotNull())
    cols = [F.col(c).asc() if a else F.col(c).desc() for c, a in order]
    return d.orderBy(*cols).limit(k)


def top_k_per_group(df: DataFrame, group: str, k: int, order: Sequence[tuple[str, bool]],
                    rank_col: str = "rank") -> DataFrame:
    """Top k rows inside each group with their 1-based rank.

    Implemented as a window ``row_number``; each group is sorted in one task, so
    use it where groups are bounded (folds, features) -- top-k over a whole
    table uses ``top_k``.
    """
    cols = [F.col(c).asc() if a else F.col(c).desc() for c, a in order]
    w = Window.partitionBy(group).orderBy(*cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def with_row_index(df: DataFrame, order: Sequence[tuple[str, bool]], out: str = "row_idx") -> DataFrame:
    """Stable 0-based index under a total order, without a single-partition window.

    Prefer a supplied id column; use this only when none exists.
    """
    return number_rows(df.orderBy(*[F.col(c).asc() if a else F.col(c).desc() for c, a in order]), out)


def number_rows(df: DataFrame, out: str) -> DataFrame:
    """``df`` with the 0-based number of each row in the order of its partitions.

    The rows are written once with ``monotonically_increasing_id``, which numbers
    those of each partition; the partitions' counts give the offsets.
    """
    s = df.withColumns({"_id": F.monotonically_increasing_id()}).checkpoint()
    part = F.shiftright("_id", 33)
    counts = s.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    return (s.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).select(*df.columns, out))
