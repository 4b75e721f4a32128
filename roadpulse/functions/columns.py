"""Column expressions.  All JVM-side built-ins (whole-stage codegen), no UDFs.

Spark runs with ANSI mode on, so every coercion of untrusted text uses the
``try_`` variants: a bad value becomes NULL instead of failing the job.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse.params import COORDINATE_PATTERN

# Single-letter fields accept both "07:05:01" and "7:5:1", like the lenient
# parser of the analysed workload.
TIMESTAMP_PATTERN = "yyyy-M-d H:m:s"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_header(name: str) -> str:
    """Collapse runs of whitespace and trim (``'OSM   ID '`` -> ``'OSM ID'``)."""
    return re.sub(r"\s+", " ", name).strip()


def strip_whitespace(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def to_number(col: Column | str) -> Column:
    """Text to double; unparsable text and NaN become NULL."""
    number = strip_whitespace(_c(col).cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_timestamp(date_col: Column | str, time_col: Column | str) -> Column:
    """``Date`` + ' ' + ``Time`` -> TIMESTAMP_NTZ, NULL when unparsable."""
    text = F.concat_ws(" ", _c(date_col), _c(time_col))
    return F.try_to_timestamp(text, F.lit(TIMESTAMP_PATTERN)).cast("timestamp_ntz")


def coordinate_part(col: Column | str, index: int) -> Column:
    """Longitude (1) or latitude (2) out of a ``'lon, lat'`` text field."""
    return to_number(F.regexp_extract(_c(col), COORDINATE_PATTERN, index))


def day_type(date_col: Column | str) -> Column:
    """'weekend' for Saturday and Sunday, else 'weekday'."""
    return F.when(F.dayofweek(_c(date_col)).isin(1, 7), F.lit("weekend")).otherwise(F.lit("weekday"))


def floor_at_zero(col: Column | str) -> Column:
    """max(x, 0) that keeps NULL as NULL (``greatest`` would turn NULL into 0)."""
    c = _c(col)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def indicator(predicate: Column) -> Column:
    """1.0 when the predicate holds, 0.0 otherwise (NULL comparison -> 0.0)."""
    return F.when(predicate, F.lit(1.0)).otherwise(F.lit(0.0))


def pct_drop(baseline: Column | str, value: Column | str) -> Column:
    """100 * (baseline - value) / baseline; NULL for a zero baseline."""
    b, v = _c(baseline), _c(value)
    return F.try_divide(F.lit(100.0) * (b - v), b)


def rounded(col: Column | str, digits: int | None) -> Column:
    """HALF_UP rounding (None: no rounding).  Float noise beyond 12 decimals is
    taken off first, so that an exact decimal tie computed in another summation
    order rounds the same way; 2.6749996 is far from a tie and gives 2.67."""
    c = _c(col)
    return c if digits is None else F.round(F.round(c, 12), digits)


def sd_from_variance(variance: Column | str, digits: int | None) -> Column:
    """Variance (rounded as reported) -> standard deviation, clamped at zero."""
    return rounded(F.sqrt(floor_at_zero(rounded(variance, digits))), digits)


def rounded_half_even(col: Column | str, digits: int) -> Column:
    """Half-to-even rounding (the rule of numpy/pandas ``round``), B8."""
    return F.bround(_c(col), digits)
