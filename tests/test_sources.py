"""File sources: UTF-16 TSV, BOM CSV, all-string scans, two-line headers, timetable feeds."""

import os
import tempfile

from pyspark.sql import functions as F

from geodemand.operators.enrich import to_number
from geodemand.sources import readers as RD


def _tmp():
    return tempfile.mkdtemp(prefix="geodemand-test-", dir="/tmp")


def test_utf16_tab_with_padded_header(spark):
    d = _tmp()
    p = os.path.join(d, "obs.tsv")
    with open(p, "w", encoding="utf-16") as fh:
        fh.write(" Station \tState\t Value\n")
        fh.write("Yuma, Arizona\tArizona\t1.5\nBoston, MA\tMassachusetts\t2\n")
    df = RD.read_delimited(spark, p, sep="\t", encoding="UTF-16")
    assert df.columns == ["Station", "State", "Value"]
    assert df.count() == 2


def test_bom_csv_and_all_strings(spark):
    d = _tmp()
    p = os.path.join(d, "codes.csv")
    with open(p, "w", encoding="utf-8-sig") as fh:
        fh.write("code,county_fips\nABC,01001\nXYZ,\n")
    df = RD.read_delimited(spark, p)
    assert df.columns == ["code", "county_fips"]
    s = RD.read_all_strings(spark, p, ["code", "county_fips"])
    assert [r.county_fips for r in s.orderBy("code").collect()] == ["01001", None]


def test_two_line_header_and_numeric_guard(spark):
    d = _tmp()
    p = os.path.join(d, "acs.csv")
    with open(p, "w") as fh:
        fh.write("GEO_ID,B1\nGeography,Estimate!!Total\n0500000US01001,-\n0500000US01003,250000+\n0500000US01005,12\n"
                 "0500000US01007,1d\n")
    df = RD.read_two_line_header(spark, p, ["GEO_ID", "B1"], "GEO_ID", "^[0-9]{7}US")
    vals = {r.GEO_ID[-5:]: r.v for r in df.select("GEO_ID", to_number("B1").alias("v")).collect()}
    assert vals == {"01001": None, "01003": None, "01005": 12.0, "01007": None}


def test_feed_loader_filters_and_days(spark):
    d = _tmp()
    files = {
        "routes.txt": "route_id,agency_id,route_type,route_long_name\nR1,51,2,Main Line\nR2,51,2,Auto Train\nR3,9,3,Bus\n",
        "trips.txt": "route_id,service_id,trip_id,direction_id\nR1,S1,T1,0\nR2,S1,T2,1\nR3,S1,T3,0\nR1,SX,T4,1\n",
        "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,08:00:00,08:01:00,A,1\n"
                          "T1,25:10:00,25:12:30,B,2\nT2,09:00:00,09:00:00,A,1\nT3,10:00:00,10:00:00,C,1\n",
        "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\nA,Alpha,40.0,-75.0\nB,Beta,41.0,-74.0\nC,Gamma,1,1\n",
        "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday\nS1,1,1,1,1,1,0,0\n",
    }
    for n, t in files.items():
        with open(os.path.join(d, n), "w") as fh:
            fh.write(t)
    sch = RD.load_schedule(spark, d, route_type=2, agency="51", exclude_names=["Auto Train"])
    assert {r.trip_id: r.days_per_week for r in sch.trips.collect()} == {"T1": 5, "T4": 0}
    assert sorted(r.trip_id for r in sch.stop_times.collect()) == ["T1", "T1"]
    from geodemand.operators.schedule import visit_times
    v = {r.stop_id: (r.dep_sec, r.dwell_sec) for r in visit_times(sch.stop_times).collect()}
    assert v == {"A": (8 * 3600 + 60, 60), "B": (25 * 3600 + 12 * 60 + 30, 150)}


def test_write_stage_versioned(spark):
    from geodemand.operators.enrich import write_stage
    d = _tmp()
    df = spark.range(5).withColumn("k", F.col("id") % 2)
    p = write_stage(df, os.path.join(d, "stage_v1"), partition_by=["k"])
    assert spark.read.parquet(p).count() == 5
