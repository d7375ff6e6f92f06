"""File sources: delimited text in any charset, all-string scans, two-line headers, timetable feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from geodemand.operators.rows import number_rows
from geodemand.operators.schedule import FEED_DAY_COLUMNS, Schedule


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
                   schema: StructType | None = None) -> DataFrame:
    """Header CSV/TSV in any charset, header names stripped of surrounding whitespace.

    UTF-16 input needs ``multiLine`` (line splitting happens after decoding);
    a UTF-8 byte-order mark is dropped by the reader.
    """
    r = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    if encoding.upper().replace("-", "") != "UTF8":
        r = r.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    df = r.csv(path)
    return df.toDF(*[c.strip().lstrip("\ufeff").strip() for c in df.columns])


def read_all_strings(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Every column as text (keeps leading zeros of codes); no schema inference pass."""
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    return spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)


def read_two_line_header(spark: SparkSession, path: str, columns: Sequence[str], id_col: str,
                         id_pattern: str) -> DataFrame:
    """Machine names on the first line, human labels on the second: keep names, drop the label row."""
    return read_all_strings(spark, path, columns).where(F.col(id_col).rlike(id_pattern))


def write_delimited(df: DataFrame, path: str, sep: str = "\t", encoding: str = "UTF-16") -> str:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return path


_FEED_SCHEMAS = {
    "routes": "route_id string, agency_id string, route_type int, route_long_name string",
    "trips": "route_id string, service_id string, trip_id string, direction_id int, shape_id string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "calendar": "service_id string, " + ", ".join(f"{d} int" for d in FEED_DAY_COLUMNS),
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
}


def _feed_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one feed file by header name; columns absent from the file come back NULL."""
    df = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/{name}.txt")
    want = [f.strip() for f in _FEED_SCHEMAS[name].split(",")]
    cols = []
    for w in want:
        n, t = w.split()
        cols.append((F.col(n).try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n))
    return df.select(*cols)


def load_schedule(spark: SparkSession, folder: str, route_type: int | None = None, agency: str | None = None,
                  exclude_names: Sequence[str] = (), with_shapes: bool = False) -> Schedule:
    """Timetable feed restricted to one mode and agency, optionally without some named routes.

    routes (filter) -> trips (semi join) -> stop_times (semi join); trips get days_per_week.
    """
    from geodemand.operators.schedule import service_days, trips_with_days
    routes = _feed_table(spark, folder, "routes")
    cond = F.lit(True)
    if route_type is not None:
        cond = cond & (F.col("route_type") == route_type)
    if agency is not None:
        cond = cond & (F.col("agency_id") == str(agency))
    if exclude_names:
        n = F.col("route_long_name")
        cond = cond & (n.isNull() | ~n.isin(list(exclude_names)))
    r = routes.where(cond)
    trips = _feed_table(spark, folder, "trips").join(r.select("route_id"), "route_id", "left_semi")
    calendar = _feed_table(spark, folder, "calendar")
    trips = trips_with_days(trips, service_days(calendar))
    st = _feed_table(spark, folder, "stop_times").join(trips.select("trip_id"), "trip_id", "left_semi")
    shapes = _feed_table(spark, folder, "shapes") if with_shapes else None
    return Schedule(routes=r, trips=trips, stop_times=st, stops=_feed_table(spark, folder, "stops"),
                    calendar=calendar, shapes=shapes)


def read_banded(spark: SparkSession, path: str, header_row: int, first_row: int, last_row: int,
                columns: Sequence[int], names: Sequence[str] | None = None) -> DataFrame:
    """Sheet-like CSV band: header on 0-based line ``header_row``, data lines first_row..last_row, chosen columns.

    Lines are numbered by partition sizes and local offsets (no single-partition
    step), so the band filter is exact and distributed; footnotes outside the band
    are dropped.
    """
    lines = number_rows(spark.read.text(path).withColumnRenamed("value", "_text"), "_line")
    parsed = lines.select("_line", F.from_csv("_text", ", ".join(f"_c{i} string" for i in range(max(columns) + 1)),
                                              {"mode": "PERMISSIVE"}).alias("_r"))
    header = parsed.where(F.col("_line") == header_row).select(
        *[F.col(f"_r._c{i}") for i in columns]).first()
    out_names = list(names) if names else [str(h).strip() for h in header]
    band = parsed.where((F.col("_line") >= first_row) & (F.col("_line") <= last_row))
    return band.select("_line", *[F.col(f"_r._c{i}").alias(n) for i, n in zip(columns, out_names)])
