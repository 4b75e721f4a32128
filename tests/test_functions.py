"""Column functions on hand-made frames (FIXTURES.md cases)."""
import datetime as dt

from pyspark.sql import functions as F

from roadpulse.functions import columns as C


def test_parse_timestamp_lenient_and_bad(spark):
    df = spark.createDataFrame([("2015-03-20", "10:11:12"), ("2015-3-2", "7:5:1"), ("bad", "10:11:12"),
                                (None, "10:11:12")], "d string, t string")
    got = [r[0] for r in df.select(C.parse_timestamp("d", "t")).collect()]
    assert got == [dt.datetime(2015, 3, 20, 10, 11, 12), dt.datetime(2015, 3, 2, 7, 5, 1), None, None]


def test_coordinate_parts(spark):
    df = spark.createDataFrame([("35.51, 33.89",), (" 351e-1 ,331e-1 ",), ("n/a",), (None,), ("1,2,3",)], "c string")
    got = [(r[0], r[1]) for r in df.select(C.coordinate_part("c", 1), C.coordinate_part("c", 2)).collect()]
    assert got == [(35.51, 33.89), (35.1, 33.1), (None, None), (None, None), (None, None)]


def test_day_type_saturday_sunday(spark):
    df = spark.createDataFrame([(dt.date(2015, 3, 20),), (dt.date(2015, 3, 21),), (dt.date(2015, 3, 22),)], "d date")
    got = [r[0] for r in df.select(C.day_type("d")).collect()]
    assert got == ["weekday", "weekend", "weekend"]
    dows = [r[0] for r in df.select(F.weekday("d")).collect()]
    assert dows == [4, 5, 6]


def test_floor_at_zero_keeps_null(spark):
    df = spark.createDataFrame([(-1.5,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(C.floor_at_zero("x")).collect()] == [0.0, 2.0, None]


def test_pct_drop_zero_baseline_is_null(spark):
    df = spark.createDataFrame([(0.0, 1.0), (20.0, 15.0)], "b double, a double")
    assert [r[0] for r in df.select(C.pct_drop("b", "a")).collect()] == [None, 25.0]


def test_rounded_stable_at_ties(spark):
    df = spark.createDataFrame([(30.0553125,), (30.055312499999996,), (1.005,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(C.rounded("x", 6)).collect()][:2] == [30.055313, 30.055313]
    assert [r[0] for r in df.select(C.rounded("x", 2)).collect()][2] == 1.01
    assert [r[0] for r in df.select(C.rounded("x", 0)).collect()][3] == -3.0


def test_normalize_header():
    assert C.normalize_header("  OSM   ID ") == "OSM ID"
    assert C.normalize_header("Coordinate  (Lon,\tLat)") == "Coordinate (Lon, Lat)"
