"""Raw CSV reading and cleaning."""
import os
import tempfile

from roadpulse.sources import fixtures as X
from roadpulse.sources import raw as R

CSV = ('Date, Time, "Coordinate  (Lon, Lat)",Course,Velocity,OSM   ID\n'
       '2015-03-20, 10:11:12, "35.51, 33.89",90,12.5,way/1\n'
       '2015-03-21, 7:05:01, "35.52, 33.88",180,,way/2\n'
       'bad, 10:11:12, "n/a",0,3.0,way/1\n')


def _write(text):
    d = tempfile.mkdtemp(prefix="rp-csv-")
    p = os.path.join(d, "raw.txt")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_read_raw_normalises_header_and_keeps_quoted_coordinate(spark):
    raw = R.read_raw(spark, _write(CSV))
    assert raw.columns == ["Date", "Time", "Coordinate (Lon, Lat)", "Course", "Velocity", "OSM ID"]
    rows = raw.collect()
    assert rows[0]["Coordinate (Lon, Lat)"] == "35.51, 33.89"
    assert rows[1]["Velocity"] is None


def test_clean_types_and_bad_rows(spark):
    clean = R.clean(R.read_raw(spark, _write(CSV)))
    assert [f.name for f in clean.schema.fields] == [f.name for f in R.CLEAN_SCHEMA.fields]
    rows = clean.orderBy("osm_id", "timestamp").collect()
    good = [r for r in rows if r["timestamp"] is not None]
    assert len(good) == 2 and len(rows) == 3
    r1 = [r for r in good if r["osm_id"] == "way/1"][0]
    assert (r1["longitude"], r1["latitude"], r1["velocity"], r1["hour"], r1["day_of_week"]) == (35.51, 33.89, 12.5, 10, 4)
    r2 = [r for r in good if r["osm_id"] == "way/2"][0]
    assert r2["velocity"] is None and r2["hour"] == 7 and r2["day_of_week"] == 5
    dropped = R.clean(R.read_raw(spark, _write(CSV)), on_bad="drop")
    assert dropped.count() == 2


def test_raw_text_fixture_defect_counts(spark, sf=None):
    from roadpulse.operators import quality as Q
    raw = X.raw_text(spark, "/root/testdata/sf0.01")
    v = Q.validity_report(raw).first()
    assert v["total_rows"] == 10100
    assert v["invalid_timestamp_rows"] == 106
    dup = Q.duplicate_report(raw).first()
    assert (dup["duplicate_groups"], dup["duplicate_rows_beyond_first"]) == (100, 100)
    miss = {r["column_name"]: r["missing_count"] for r in Q.null_audit(raw).collect()}
    assert miss["Velocity"] == 129 and miss["Date"] == 0
