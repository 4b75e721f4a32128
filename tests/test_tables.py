"""Sinks and table helpers."""
import os
import tempfile

from pyspark.sql import functions as F

from roadpulse.operators import daily as D
from roadpulse.sources import fixtures as X
from roadpulse.sources import raw as R
from roadpulse.sources import tables as T


def test_clean_observations_partitioned_by_date(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="rp-clean-"), "clean")
    T.write_clean_observations(X.observations(spark, "/root/testdata/sf0.001", "dense").drop("event_id"), out)
    dirs = sorted(d for d in os.listdir(out) if d.startswith("date="))
    assert len(dirs) == 30
    back = T.load_table(spark, out)
    pruned = back.where(F.col("date") == "2024-01-05")
    assert "PartitionFilters: [isnotnull(date" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == back.where(F.col("date") == "2024-01-05").count() > 0


def test_bucketed_daily_summary_aggregates_without_shuffle(spark):
    daily = D.daily_segment_hour(X.observations(spark, "/root/testdata/sf0.01", "dense"), 1)
    t = T.save_bucketed(daily, "daily_segment_hour_bucketed", key="osm_id", buckets=8)
    assert spark.catalog.tableExists("daily_segment_hour_bucketed")
    per_segment = t.groupBy("osm_id").agg(F.avg("daily_average_velocity"))
    assert "Exchange" not in per_segment._jdf.queryExecution().executedPlan().toString()
    assert per_segment.count() == 20


def test_csv_round_trip_with_schema_and_register(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="rp-csv-"), "f")
    df = spark.createDataFrame([("way/1", 1.5), ("way/2", None)], "osm_id string, median_velocity double")
    T.write_table(df, out, fmt="csv")
    back = T.load_table(spark, out, fmt="csv", schema=df.schema)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    T.register(back, "features_view")
    T.register(df.limit(0), "features_view", replace=False)  # load-once guard keeps the first
    assert T.run_query(spark, "SELECT COUNT(*) AS n FROM features_view").first()["n"] == 2


def test_preview_is_bounded_and_ordered(spark):
    raw = X.raw_text(spark, "/root/testdata/sf0.001")
    p = R.preview(raw, 5, order_by=("OSM ID", "Date", "Time"))
    assert p.count() == 5
