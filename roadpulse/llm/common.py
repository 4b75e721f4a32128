"""Column helpers and hand-over helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.session import materialize

#: Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"

__all__ = ["BROADCAST_BYTES", "WHITE", "WHITE_CHARS", "count_of", "give_back", "let", "materialize", "row_key", "small", "solid_chars", "table", "white_words"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def white_words(text: Column) -> Column:
    """The white-space separated words of ``text`` (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` in the class ``chars`` (the inside of a character class)."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{chars}]+", ""))


def solid_chars(text: Column) -> Column:
    """Code points of ``text`` that are not white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.  A lambda that mentions an
    outer expression evaluates it again for each element; a lambda variable it
    only reads."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits (two longs) of a row's id and text, never null: rows share them only if equal in both."""
    parts = (doc_id.isNull(), doc_id, text.isNull(), text)
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


#: Octets that a table sent to all workers may have.
BROADCAST_BYTES = 32 << 20


def width(df: DataFrame) -> Column:
    """Octets of a row, about as Spark lays it out: eight for each value, and what its texts and arrays hold."""
    held = F.lit(16)
    for f in df.schema.fields:
        held = held + 8
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            held = held + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            held = held + 8 * F.greatest(F.size(f.name), F.lit(0))
    return held


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_bytes`` (measured, so
    call it on written tables); beyond that it stays a shuffle join."""
    held = df.agg(F.sum(width(df).cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if held <= max_bytes else df


def give_back() -> None:
    """Return a Python worker's freed memory to the system (workers stay alive between tasks)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
