"""Adapter views that turn the supplied ``events`` table into observations.

``events`` (event_id, ts, user_id, event_type, value, props) stands in for the
GPS observation file: ``value`` is the velocity and a segment key is derived
from ``user_id`` -- ``dense`` folds users onto 20 segments, ``sparse`` keeps one
segment per user.  Coordinates and course are deterministic functions of the
ids.  The same definitions, written in DuckDB SQL, live in
``roadpulse.plans.oracle`` so that both engines read identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_EXPR = {"dense": "user_id % 20", "sparse": "user_id"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def observations(spark: SparkSession, sf_dir: str, segment: str = "dense") -> DataFrame:
    """Clean-observation view of ``events`` (schema of ``sources.raw.CLEAN_SCHEMA``
    plus ``event_id``).  Literals are SQL decimals so both engines produce the
    same doubles."""
    seg = SEGMENT_EXPR[segment]
    ev = events(spark, sf_dir)
    ts = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    return ev.select(
        "event_id",
        ts.alias("timestamp"),
        F.col("ts").cast("date").alias("date"),
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.weekday("ts").alias("day_of_week"),
        F.hour("ts").cast("int").alias("hour"),
        F.expr("CAST(35.1 + (user_id % 20) * 0.05 + (event_id % 10) * 0.001 AS DOUBLE)").alias("longitude"),
        F.expr("CAST(33.1 + (user_id % 20) * 0.05 + (event_id % 7) * 0.001 AS DOUBLE)").alias("latitude"),
        F.expr("CAST((event_id * 37) % 360 AS DOUBLE)").alias("course"),
        F.col("value").cast("double").alias("velocity"),
        F.concat(F.lit("way/"), F.expr(f"CAST({seg} AS STRING)")).alias("osm_id"),
    )


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six text columns in the raw file layout, with injected defects so the
    cleaner and the quality report have something to find:

    * ``event_id % 97 = 0``  -> Date ``'bad'`` (unparsable timestamp)
    * ``event_id % 89 = 0``  -> coordinate ``'n/a'`` (unparsable)
    * else ``% 83 = 0``      -> ``'999.0, 33.0'`` (longitude out of range)
    * ``event_id % 79 = 0``  -> Velocity missing (NULL, as a CSV reader gives)
    * rows with ``event_id % 101 = 0`` appear twice (exact duplicates)
    """
    ev = events(spark, sf_dir)
    eid = F.col("event_id")
    seg = F.col("user_id") % 20
    valid_coord = F.concat(
        (F.lit(351) + seg).cast("string"), F.lit("e-1, "), (F.lit(331) + seg).cast("string"), F.lit("e-1")
    )
    rows = ev.select(
        F.when(eid % 97 == 0, F.lit("bad")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("Date"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
        F.when(eid % 89 == 0, F.lit("n/a"))
        .when(eid % 83 == 0, F.lit("999.0, 33.0"))
        .otherwise(valid_coord)
        .alias("Coordinate (Lon, Lat)"),
        ((eid * 37) % 360).cast("string").alias("Course"),
        F.when(eid % 79 == 0, F.lit(None).cast("string")).otherwise(F.col("value").cast("string")).alias("Velocity"),
        F.concat(F.lit("way/"), seg.cast("string")).alias("OSM ID"),
        eid.alias("_eid"),
    )
    dupes = rows.where(F.col("_eid") % 101 == 0)
    return rows.unionByName(dupes).drop("_eid")


def raw_lines(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """The lines of a raw text file: a header in each part, quoted coordinates
    after a space, and per ``event_id``:

    * ``% 53 = 0``      -> Velocity ``'NA'``, ``% 59 = 0`` -> Course ``'null'``
    * ``% 61 = 0``      -> a short line without its last two fields
    * else ``% 67 = 0`` -> a long line with two more fields

    ``ordered``: whole lines alone, in order of ``event_id``, in several parts."""
    ev = events(spark, sf_dir)
    eid, seg = F.col("event_id"), F.col("user_id") % 20
    course = F.when(eid % 59 == 0, F.lit("null")).otherwise(((eid * 37) % 360).cast("string"))
    velocity = F.when(eid % 53 == 0, F.lit("NA")).otherwise(F.col("value").cast("string"))
    head = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(", "), F.date_format("ts", "HH:mm:ss"), F.lit(', "'),
                    (F.lit(351) + seg).cast("string"), F.lit("e-1, "), (F.lit(331) + seg).cast("string"), F.lit('e-1", '), course)
    whole = F.concat(head, F.lit(","), velocity, F.lit(",way/"), seg.cast("string"))
    line = F.when(eid % 61 == 0, head).when(eid % 67 == 0, F.concat(whole, F.lit(",x,y"))).otherwise(whole)
    lines = ev.select(eid.alias("_eid"), line.alias("value"))
    if ordered:
        lines = ev.where((eid % 61 != 0) & (eid % 67 != 0)).select(eid.alias("_eid"), whole.alias("value"))
        lines = lines.repartitionByRange(4, "_eid").sortWithinPartitions("_eid")
    header = "Date, Time, \"Coordinate  (Lon, Lat)\",Course,Velocity,OSM   ID"

    def with_header(batches):
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for batch in batches:
            yield batch.select(["value"])

    return lines.mapInArrow(with_header, "value string")


def fixed_assignment(features: DataFrame, k: int = 5) -> DataFrame:
    """Deterministic cluster ids for oracle-checkable cluster statistics:
    the numeric part of the segment key modulo ``k``."""
    return features.withColumn(
        "cluster_id", (F.regexp_extract("osm_id", r"(\d+)$", 1).cast("long") % k).cast("int")
    )
