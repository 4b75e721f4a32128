"""Raw delimited observations -> typed clean observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.functions.columns import coordinate_part, normalize_header, parse_timestamp, to_number
from roadpulse.params import MISSING_TOKENS, RAW_COLUMNS

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

CLEAN_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("year", T.IntegerType(), True),
    T.StructField("month", T.IntegerType(), True),
    T.StructField("day_of_week", T.IntegerType(), True),
    T.StructField("hour", T.IntegerType(), True),
    T.StructField("longitude", T.DoubleType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("course", T.DoubleType(), True),
    T.StructField("velocity", T.DoubleType(), True),
    T.StructField("osm_id", T.StringType(), True),
])


def normalize_columns(df: DataFrame) -> DataFrame:
    """Header normalisation (metadata only, no data pass)."""
    return df.toDF(*[normalize_header(c) for c in df.columns])


def _reader(spark: SparkSession):
    return (
        spark.read.option("header", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("quote", '"')
        .option("mode", "PERMISSIVE")
    )


def with_missing(df: DataFrame, tokens: tuple[str, ...] = MISSING_TOKENS) -> DataFrame:
    """Texts that stand for a missing value become NULL, quoted or not."""
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_raw(spark: SparkSession, path: str, header_driven: bool = True,
             missing: tuple[str, ...] = MISSING_TOKENS) -> DataFrame:
    """Comma-separated raw observations with a header line.

    Every column is read as text (no type inference pass over the data);
    ``ignoreLeadingWhiteSpace`` is required so that a space before a quoted
    coordinate does not split it in two.  With ``header_driven`` the file's own
    header names are used and normalised; otherwise the canonical six-column
    schema is imposed positionally.  Texts in ``missing`` are missing values.
    A line with fewer fields has missing values at its end, one with more loses
    the rest; ``read_checked`` tells them apart.
    """
    if header_driven:
        return with_missing(normalize_columns(_reader(spark).option("inferSchema", False).csv(path)), missing)
    return with_missing(_reader(spark).schema(RAW_SCHEMA).option("enforceSchema", True).csv(path), missing)


LINE = "_line"


def read_checked(spark: SparkSession, path: str, short_lines: str = "keep",
                 missing: tuple[str, ...] = MISSING_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): the raw observations, and the lines that are none.

    A line with more fields than the header has is rejected, since its values
    cannot be told to columns.  One with fewer is kept with missing values at
    its end, as the analysed reader does, or rejected too (``short_lines='reject'``).
    ``rejected`` has (file, line, n_fields, reason); rows and rejected lines
    together are all lines but the header and empty ones."""
    if short_lines not in ("keep", "reject"):
        raise ValueError(f"short_lines must be 'keep' or 'reject', not {short_lines!r}")
    names = [normalize_header(c) for c in _reader(spark).option("inferSchema", False).csv(path).columns]
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in (*names, LINE)])
    # with pruned columns the fields of a line would not be counted
    lines = _reader(spark).schema(schema).option("columnNameOfCorruptRecord", LINE).option("columnPruning", False).csv(path)
    fields = F.regexp_count(F.regexp_replace(LINE, r'"[^"]*"', ""), F.lit(",")) + 1
    # Spark refuses to read the line's text alone, so the first column has a part in the condition
    told = F.length(F.concat_ws("", F.col(LINE), F.col(f"`{names[0]}`"))) > 0
    bad = F.col(LINE).isNotNull() & told & (fields > len(names) if short_lines == "keep" else fields != len(names))
    rows = with_missing(lines.where(~F.coalesce(bad, F.lit(False))).select(*[F.col(f"`{c}`") for c in names]), missing)
    reason = F.when(fields > len(names), F.lit("more fields than the header")).otherwise(F.lit("fewer fields than the header"))
    rejected = lines.where(F.coalesce(bad, F.lit(False))).select(
        F.col("_metadata.file_path").alias("file"), F.col(LINE).alias("line"), fields.cast("int").alias("n_fields"), reason.alias("reason"))
    return rows, rejected


def parsed(raw: DataFrame) -> DataFrame:
    """Raw text plus parsed timestamp, longitude, latitude, course and velocity."""
    return raw.select(
        "*",
        parse_timestamp("Date", "Time").alias("_ts"),
        coordinate_part("Coordinate (Lon, Lat)", 1).alias("_lon"),
        coordinate_part("Coordinate (Lon, Lat)", 2).alias("_lat"),
        to_number("Course").alias("_course"),
        to_number("Velocity").alias("_velocity"),
    )


def clean(raw: DataFrame, on_bad: str = "null", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed clean observations (timestamp, date parts, coordinates, numbers, segment).

    ``on_bad='null'`` keeps rows with an unparsable timestamp (NULL time parts);
    ``on_bad='drop'`` removes them; ``on_bad='fail'`` raises at execution time via
    ``raise_error`` when one is met (the strict behaviour of the export pass).
    Columns of ``keep`` are handed through.
    """
    p = parsed(raw)
    ts = F.col("_ts")
    if on_bad == "drop":
        p = p.where(ts.isNotNull())
    elif on_bad == "fail":
        ts = F.when(ts.isNull(), F.raise_error(F.lit("missing or unparsable timestamp")).cast("timestamp_ntz")).otherwise(ts)
    elif on_bad != "null":
        raise ValueError(f"on_bad must be 'null', 'drop' or 'fail', not {on_bad!r}")
    return p.select(
        ts.alias("timestamp"),
        F.to_date(ts).alias("date"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.weekday(ts).alias("day_of_week"),  # Monday = 0
        F.hour(ts).alias("hour"),
        F.col("_lon").alias("longitude"),
        F.col("_lat").alias("latitude"),
        F.col("_course").alias("course"),
        F.col("_velocity").alias("velocity"),
        F.col("OSM ID").cast("string").alias("osm_id"),
        *keep,
    )


def preview(df: DataFrame, n: int = 10_000, order_by: tuple[str, ...] = ()) -> DataFrame:
    """Bounded preview of a frame: the first ``n`` rows in ``order_by`` order, or any ``n`` rows."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def preview_files(spark: SparkSession, path: str, n: int = 10_000) -> DataFrame:
    """The first ``n`` rows in file order (A2): files by path, lines by place.

    Files are taken one by one until there are enough rows.  Of a file, Spark's
    incremental ``take`` reads the first splits and goes on only while rows are
    missing; the place of each split orders what it returns.  The ``n`` rows
    go through the driver, which is what a preview is for."""
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").toLocalIterator()
    rows: list = []
    schema = None
    for file in files:
        one = read_raw(spark, file["path"])
        names = one.columns
        placed = normalize_columns(_reader(spark).option("inferSchema", False).csv(file["path"])).select(
            *[F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in names],
            F.col("_metadata.file_block_start").alias("_block"))
        schema = schema or one.schema
        found = sorted(placed.take(n - len(rows)), key=lambda r: r["_block"])
        rows += [tuple(r)[:-1] for r in found]
        if len(rows) >= n:
            break
    return spark.createDataFrame(rows, schema or RAW_SCHEMA)
