"""Missing daily means, rounding, missing keys and strict cleaning."""
import pytest
from pyspark.sql import functions as F

from roadpulse.functions.columns import rounded, to_number
from roadpulse.operators import insights, quality, slowdown
from roadpulse.sources import raw as RAW

DAILY = "osm_id string, observation_date date, hour int, daily_observation_count long, daily_average_velocity double"


@pytest.fixture(scope="module")
def daily(spark):
    rows = [("a", "2024-01-01", 7, 9, 10.0), ("a", "2024-01-01", 8, 9, 30.0), ("a", "2024-01-02", 7, 9, None)]
    return spark.createDataFrame(rows, DAILY.replace("date date", "date string")).withColumn(
        "observation_date", F.to_date("observation_date"))


def test_bottleneck_baseline_ignores_missing_means(daily):
    row = slowdown.candidate_bottlenecks(daily, min_days=1, min_obs=1).first()
    assert (row.hour, row.baseline_velocity, row.slowdown_percentage) == (7, 20.0, 50.0)


def test_cluster_hour_profile_ignores_missing_means(spark, daily):
    clusters = spark.createDataFrame([("a", "x")], "osm_id string, cluster_label string")
    got = {r.hour: r.relative_slowdown for r in insights.cluster_hour_profile(daily, clusters).collect()}
    assert got == {7: 10.0, 8: -10.0}


@pytest.mark.parametrize("value,want", [(2.6749996, 2.67), (0.1249996, 0.12), (2.675, 2.68), (0.1 + 0.2, 0.3), (-2.5e-3, 0.0)])
def test_rounding_is_single(spark, value, want):
    assert spark.range(1).select(rounded(F.lit(value), 2)).first()[0] == want


def test_nan_text_is_missing(spark):
    df = spark.createDataFrame([("NaN",), ("1.5",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(to_number("t")).collect()] == [None, 1.5, None, None]


def test_near_zero_shares_drop_missing_keys_after_the_total(spark):
    obs = spark.createDataFrame([("a", 1, 0.0), ("a", None, 0.0), (None, 1, 0.0), ("b", 2, 0.0)], "osm_id string, hour int, velocity double")
    assert [(r[0], r[1], r[2]) for r in quality.near_zero_by_hour(obs).collect()] == [(1, 2, 50.0), (2, 1, 25.0)]
    assert [(r[0], r[1], r[2]) for r in quality.near_zero_by_segment(obs).collect()] == [("a", 2, 50.0), ("b", 1, 25.0)]


def test_strict_cleaning_raises_for_a_missing_date(spark):
    cols = ["Date", "Time", "Coordinate (Lon, Lat)", "Course", "Velocity", "OSM ID"]
    raw = spark.createDataFrame([(None, "00:00:00", "1,2", "0", "1", "a")], ", ".join(f"`{c}` string" for c in cols))
    with pytest.raises(Exception, match="timestamp"):
        RAW.clean(raw, on_bad="fail").collect()
    assert RAW.clean(raw).first().timestamp is None
