"""Loads that can be repeated, and a daily summary that is refreshed in part.

The loaded table is laid out as ``load=<name>/date=<day>``: a load owns its
folder, so running it again replaces what it wrote and nothing else, other
loads may hold rows of the same dates, and a filter on the date prunes files.

The summary keeps (rows, values, sum) per segment, date and hour, one partition
per date.  Counts and sums can be computed per date alone, so a change of some
dates rewrites their partitions only; averages and the minimum number of rows
are applied when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.session import materialize


def load(clean: DataFrame, table: str, name: str) -> None:
    """Write the observations of one input as the load ``name`` of ``table``; the same load again replaces itself."""
    if not name or "/" in name:
        raise ValueError(f"a load's name is one folder: {name!r}")
    dealt = clean.hint("rebalance", "date")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(f"{table.rstrip('/')}/load={name}")


def loaded(spark: SparkSession, table: str) -> DataFrame:
    """All loads of ``table``, with columns ``load`` and ``date``."""
    found = spark.read.option("recursiveFileLookup", "false").parquet(table)
    return found.withColumn("load", F.col("load").cast("string")).withColumn("date", F.col("date").cast("date"))


def has_load(spark: SparkSession, table: str, name: str) -> bool:
    """Whether ``table`` has rows of the load ``name`` (guard of a load that runs once)."""
    from pyspark.errors import AnalysisException
    try:
        return not loaded(spark, table).where(F.col("load") == name).isEmpty()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return False
        raise


def dates_of(observations: DataFrame) -> DataFrame:
    return observations.select("date").where(F.col("date").isNotNull()).distinct()


def daily_state(observations: DataFrame) -> DataFrame:
    """(osm_id, hour, n_rows, n_values, total, date): what averages of any further grouping need."""
    return observations.where(F.col("date").isNotNull()).groupBy("osm_id", "hour", "date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("velocity").alias("n_values"), F.sum("velocity").alias("total")).select(
        "osm_id", "hour", "n_rows", "n_values", "total", "date")


def rebuild_daily(observations: DataFrame, summary: str) -> None:
    """Write the summary of all dates anew."""
    daily_state(observations).hint("rebalance", "date").write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy("date").parquet(summary)


def refresh_daily(observations: DataFrame, summary: str, dates: DataFrame) -> None:
    """Recompute the partitions of ``dates`` (one column, the changed or added dates) from the observations.

    The dates are few (a calendar), and as a semi-join they prune the observations' partitions.  A date that has no
    rows any more gets a partition with a row that counts none, which readers leave out."""
    dates = materialize(dates.select(F.col(dates.columns[0]).cast("date").alias("date")).where("date IS NOT NULL").distinct(), "changed-dates")
    state = daily_state(observations.join(dates, "date", "left_semi"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("n_rows", "n_values", "date") else
               F.lit(0).cast("long").alias(f.name) if f.name != "date" else F.col("date") for f in state.schema.fields]
    gone = dates.join(state.select("date").distinct(), "date", "left_anti").select(*nothing)
    rows = state.unionByName(gone).hint("rebalance", "date")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(summary)


def daily_summary(spark: SparkSession, summary: str, min_daily_obs: int = 5) -> DataFrame:
    """The daily segment-hour summary out of the stored counts and sums."""
    state = spark.read.parquet(summary).where(F.col("n_rows") >= max(min_daily_obs, 1))
    return state.select("osm_id", F.col("date").cast("date").alias("observation_date"), F.col("hour").cast("int").alias("hour"),
                        F.col("n_rows").alias("daily_observation_count"), F.try_divide("total", "n_values").alias("daily_average_velocity"))
