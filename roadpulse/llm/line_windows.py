"""Line deduplication by overlapping three-line windows (operator 6).

A document's lines are its text split at line feeds; blank lines neither start
nor fill a window.  Every run of three consecutive non-blank lines (trimmed) is
hashed to 128 bits.  A window that occurs more than once anywhere keeps its
first occurrence, by (doc_id, text hash, row, position); the positions covered by
later occurrences are merged per row and their lines removed.  The first
occurrence of any line's content is never removed, since a removed line always
has an equal one in an earlier window.

Windows are counted with a map-side combining aggregate (a window that a third
of all documents share is one row per input partition) and only repeated ones
are joined back; the engine may split that join where one window is hot.
Rows are written once with a number of their own, so that rows equal in doc_id
and text are told apart too.  Covered positions are gathered per row, bounded
by its length, and the texts are joined once by row.

Defined cases: null texts stay null, empty ones empty; documents of fewer than
three non-blank lines have no window and stay as they are; of rows equal in
doc_id and text the first keeps what the others lose; a null doc_id sorts
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import WHITE_CHARS, let, materialize

LINES_PER_WINDOW = 3


def numbered_lines(text: Column) -> Column:
    """array<struct<i, line>>: non-blank lines, trimmed, with their position."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"),
                        lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(WHITE_CHARS)).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def windows(text: Column, k: int) -> Column:
    """array<struct<h1, h2, places>>: two hashes of each window and the positions it covers."""

    def of(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(lines) - k)
        part = lambda s: F.slice(lines, s + 1, k)
        return F.transform(starts, lambda s: F.struct(
            F.xxhash64(F.transform(part(s), lambda x: x["line"])).alias("h1"),
            F.xxhash64(F.lit(k), F.transform(part(s), lambda x: x["line"])).alias("h2"),
            F.transform(part(s), lambda x: x["i"]).alias("places")))

    none = F.array().cast("array<struct<h1:bigint,h2:bigint,places:array<int>>>")
    return let(numbered_lines(text), lambda lines: F.when(F.size(lines) >= k, of(lines)).otherwise(none))


def covered(docs: DataFrame, k: int) -> DataFrame:
    """(row, removed): the positions to remove, per row of ``docs`` (row, doc_id, text) that has any."""
    rows = docs.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), F.explode(windows(F.col("text"), k)).alias("w"))
    rows = materialize(rows.select("row", "doc_id", "text_hash", "w.h1", "w.h2", "w.places"), "line-windows")
    place = F.struct("doc_id", "text_hash", "row", F.get("places", F.lit(0)).alias("at"))
    repeated = (rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                .where("n > 1").select("h1", "h2", "first"))
    repeated = materialize(repeated, "repeated-windows")
    later = rows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("row", F.explode("places").alias("i")).groupBy("row").agg(F.collect_set("i").alias("removed"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = LINES_PER_WINDOW) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for every row of ``docs``."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    plain = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "line-rows")
    gone = materialize(covered(plain, k), "covered-lines")
    # always a shuffle join: how many documents repeat something grows with the input
    joined = plain.join(gone.hint("merge"), "row", "left")
    lines = F.split(F.col("text"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")  # by a hash set, in order
    left = let(lines, lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n"))
    return joined.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(left).alias("text"),
                         F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"))
