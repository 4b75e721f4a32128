"""Sinks and table loaders (Parquet by default, CSV on request)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (),
                mode: str = "overwrite") -> None:
    """Write a result table.  ``fmt='csv'`` writes a header line per file."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_clean_observations(clean: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Clean observations, partitioned by date so date filters prune files."""
    write_table(clean, path, fmt=fmt, partition_by=("date",) if fmt == "parquet" else ())


def save_bucketed(df: DataFrame, table: str, key: str = "osm_id", buckets: int = 64,
                  sort_by: tuple[str, ...] = ()) -> DataFrame:
    """Drop-and-rebuild a catalog table bucketed on ``key`` so later joins and
    aggregations on the key read co-located data without a shuffle."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    w = df.write.mode("overwrite").bucketBy(buckets, key)
    if sort_by:
        w = w.sortBy(*sort_by)
    w.saveAsTable(table)
    return spark.table(table)


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        r = spark.read.option("header", True)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", False)
        return r.csv(path)
    raise ValueError(f"unsupported format {fmt!r}")


def register(df: DataFrame, name: str, replace: bool = True) -> DataFrame:
    """Expose a frame to ``spark.sql`` under ``name`` (queryable table)."""
    if replace or not df.sparkSession.catalog.tableExists(name):
        df.createOrReplaceTempView(name)
    return df


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    """SQL text to a lazily planned frame (A8); tables come from ``register``."""
    return spark.sql(sql)
