"""The file path: checked reading, observed writing, repeatable loads, partial refresh, previews, SQL texts."""
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from roadpulse.operators import daily as D
from roadpulse.operators import feasibility as FZ
from roadpulse.operators import quality as Q
from roadpulse.params import MISSING_TOKENS
from roadpulse.plans import sql as SQL
from roadpulse.plans import stages
from roadpulse.sources import fixtures as X
from roadpulse.sources import load as L
from roadpulse.sources import raw as R

SF = "/root/testdata/sf0.001"
HEADER = 'Date, Time, "Coordinate  (Lon, Lat)",Course,Velocity,OSM   ID\n'
LINES = ['2015-03-20, 10:11:12, "35.51, 33.89",90,12.5,way/1', '2015-03-20, 10:11:13, "35.51, 33.89",NA,null,way/1', '2015-03-21, 7:05:01',
         '2015-03-21, 7:05:01, "0, 33.88",180,3.5,way/2,one too many', '', 'bad, 10:11:12, "n/a",N/A,"NA",way/1',
         '2015-03-22, 1:00:00, "200, 33.88",1,2,way/3,x,"y,z"', '2015-03-22, 1:00:00, "0, 95",1,0.05,way/3']


def written(tmp_path, name="raw.txt", lines=LINES):
    path = tmp_path / name
    path.write_text(HEADER + "\n".join(lines) + "\n")
    return str(path)


def test_checked_reading_keeps_every_line(spark, tmp_path):
    rows, rejected = R.read_checked(spark, written(tmp_path))
    assert rows.count() + rejected.count() == len([x for x in LINES if x])
    got = {(r["Time"], r["OSM ID"]): r for r in rows.collect()}
    assert got["10:11:13", "way/1"]["Velocity"] is None and got["10:11:13", "way/1"]["Course"] is None
    assert got["10:11:12", "way/1"]["Date"] in ("bad", "2015-03-20")
    assert got["7:05:01", None]["Coordinate (Lon, Lat)"] is None  # a short line
    bad = sorted((r["n_fields"], r["reason"], r["line"][:10], r["file"].endswith("raw.txt")) for r in rejected.collect())
    assert bad == [(7, "more fields than the header", "2015-03-21", True), (8, "more fields than the header", "2015-03-22", True)]
    strict, more = R.read_checked(spark, written(tmp_path), short_lines="reject")
    assert (strict.count(), more.count()) == (4, 3)
    with pytest.raises(ValueError):
        R.read_checked(spark, written(tmp_path), short_lines="pad")


def test_missing_tokens_are_missing_in_the_audit(spark, tmp_path):
    lines = [f'2015-03-20, 10:11:12, "35.5, 33.8",1,{t},way/1' for t in MISSING_TOKENS] + ['2015-03-20, 10:11:12, "35.5, 33.8",1,nada,way/1']
    audit = {r["column_name"]: r["missing_count"] for r in Q.null_audit(R.read_raw(spark, written(tmp_path, lines=lines))).collect()}
    assert audit["Velocity"] == len(MISSING_TOKENS) and audit["Date"] == 0


def test_preview_is_in_file_order_and_stops_early(spark, tmp_path):
    for name, start in (("b.txt", 100), ("a.txt", 0), ("c.txt", 200)):
        written(tmp_path, name, [f'2015-03-20, 10:11:12, "35.5, 33.8",{start + i},1,way/1' for i in range(50)])
    got = [int(r["Course"]) for r in R.preview_files(spark, str(tmp_path), 70).collect()]
    assert got == [*range(50), *range(100, 120)]
    assert R.preview_files(spark, str(tmp_path), 1000).count() == 150


def test_preview_of_a_file_in_many_splits(spark, tmp_path):
    written(tmp_path, lines=[f'2015-03-20, 10:11:12, "35.5, 33.8",{i},1,way/1' for i in range(5000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [int(r["Course"]) for r in R.preview_files(spark, str(tmp_path), 1234).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [*range(1234)]


def test_observed_counts_equal_separate_reports(spark, tmp_path):
    raw, _ = R.read_checked(spark, written(tmp_path))
    counts = FZ.write_observed(raw, str(tmp_path / "clean"))
    assert counts["total_rows"] == raw.count() == 5
    assert (counts["zero_coordinate_rows"], counts["out_of_range_coordinate_rows"], counts["unparsed_coordinate_rows"]) == (1, 1, 2)
    assert (counts["near_zero"], counts["missing Velocity"], counts["missing Course"], counts["missing OSM ID"]) == (1, 3, 3, 1)
    got = FZ.reports(spark, counts, raw.columns)
    assert got["validity_report"].select("total_rows", "invalid_timestamp_rows", "invalid_coordinate_rows", "zero_coordinate_rows",
                                         "out_of_range_coordinate_rows", "min_timestamp", "max_timestamp").collect() == Q.validity_report(raw).collect()
    assert sorted(got["null_audit"].collect()) == sorted(Q.null_audit(raw).collect())
    assert sorted(d for d in os.listdir(tmp_path / "clean") if d.startswith("date=")) == [
        "date=2015-03-20", "date=2015-03-21", "date=2015-03-22", "date=__HIVE_DEFAULT_PARTITION__"]


def test_observed_counts_of_nothing(spark, tmp_path):
    raw = R.read_raw(spark, written(tmp_path, lines=[]))
    counts = FZ.write_observed(raw, str(tmp_path / "clean"))
    assert counts["total_rows"] == 0 and counts["velocity_mean"] is None
    assert FZ.reports(spark, counts, raw.columns)["near_zero_report"].first()["pct_near_zero"] is None


def test_load_again_changes_nothing_and_replaces_itself(spark, tmp_path):
    table = str(tmp_path / "table")
    obs = X.observations(spark, SF, "dense").drop("event_id")
    assert not L.has_load(spark, table, "one")
    L.load(obs.where("hour < 12"), table, "one")
    L.load(obs.where("hour >= 12"), table, "two")
    first = sorted(L.loaded(spark, table).collect())
    L.load(obs.where("hour < 12"), table, "one")
    assert sorted(L.loaded(spark, table).collect()) == first and len(first) == 1000
    L.load(obs.where("hour < 6"), table, "one")  # a corrected input with fewer dates and rows
    assert L.loaded(spark, table).count() == obs.where("hour < 6 OR hour >= 12").count()
    assert L.has_load(spark, table, "one") and not L.has_load(spark, table, "three")
    pruned = L.loaded(spark, table).where(F.col("date") == "2024-01-05")
    assert "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        L.load(obs, table, "a/b")


def test_refresh_equals_rebuild_and_touches_only_its_dates(spark, tmp_path):
    obs = X.observations(spark, SF, "dense")
    summary = str(tmp_path / "summary")
    L.rebuild_daily(obs, summary)
    held = {d: sorted(os.listdir(f"{summary}/{d}")) for d in os.listdir(summary) if d.startswith("date=")}
    dates = sorted(r[0] for r in L.dates_of(obs).collect())
    changed = obs.where(F.col("date") != dates[3]).withColumn("velocity", F.when(F.col("date") == dates[1], F.col("velocity") * 2).otherwise(F.col("velocity")))
    L.refresh_daily(changed, summary, spark.createDataFrame([(dates[1],), (dates[3],)], "d date"))
    got = sorted(L.daily_summary(spark, summary, 1).collect())
    assert got == sorted(D.daily_segment_hour(changed, 1).collect())
    now = {d: sorted(os.listdir(f"{summary}/{d}")) for d in os.listdir(summary) if d.startswith("date=")}
    assert {d for d in held if held[d] != now[d]} == {f"date={dates[1]}", f"date={dates[3]}"}


def test_named_sql_takes_values_as_parameters(spark):
    obs = X.observations(spark, SF, "dense")
    stages.register_views(obs, D.daily_segment_hour(obs, 1))
    with pytest.raises(KeyError):
        SQL.run_named(spark, "no_such_analysis")
    with pytest.raises(AnalysisException):
        SQL.run_named(spark, "weekday_weekend", n=5, digits=2).collect()  # a threshold is missing
    few = SQL.run_named(spark, "relative_slowdowns", min_obs=1, n=3, digits=2)
    assert few.count() == 3 and SQL.run_named(spark, "relative_slowdowns", min_obs=10_000, n=3, digits=2).count() == 0


def test_hash_seeded_fits_do_not_depend_on_partitions(spark):
    import random

    from roadpulse.operators import cluster as C
    rnd = random.Random(4)
    rows = [(f"way/{i}", rnd.gauss(3 * (i % 4), 0.4), rnd.gauss(-2 * (i % 3), 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "osm_id string, a_scaled double, b_scaled double")
    fits = [C.best_fits(d, [2, 5], 4, 7, ["a", "b"]) for d in (df.coalesce(1), df.repartition(7))]
    for k in (2, 5):
        a, b = (f[k].centers for f in fits)
        assert len(a) == k and all(abs(x - y) < 1e-9 for u, v in zip(a, b) for x, y in zip(u, v))
    starts = C.seeded_centres(df, 5, 3, 7, ["a", "b"])
    points = {(r[1], r[2]) for r in rows}
    assert all(tuple(c) in points for cs in starts.values() for c in cs) and len({tuple(map(tuple, c)) for c in starts.values()}) == 3
    same = spark.createDataFrame([("x", 1.0, 1.0), ("y", 1.0, 1.0)], df.schema)
    assert C.seeded_centres(same, 3, 2, 7, ["a", "b"]) == {0: [[1.0, 1.0]], 1: [[1.0, 1.0]]}  # no more rows that differ


def test_reports_that_can_go_wrong_do_cut(spark):
    """The inputs with gaps, limits and holes give other results than their whole counterparts."""
    from roadpulse.plans.registry import QUERIES
    sf = "/root/testdata/sf0.01"
    assert QUERIES["gappy_coverage_summary"](spark, sf).first()["gaps_longer_than_one_day"] > 3
    assert len({r["gap_days"] for r in QUERIES["gappy_date_gaps"](spark, sf).collect()}) > 2
    assert 0 < QUERIES["sparse_top_segment_share"](spark, sf).first()["share"] < 0.5
    assert {r["confidence"] for r in QUERIES["severity_two_labels"](spark, sf).collect()} == {"Lower", "Standard"}
