"""Benchmark decontamination with spaced seeds (operator 4).

Words are lower-cased runs of letters and digits.  Each of the fixed masks
slides over a text; the hash of the words at its set positions ignores those in
between, so a substituted word there does not break the hit.  Hashes of the
documents are joined with those of the benchmark; every hit names a diagonal
(document position minus item position), on which the item is laid over the
document and compared word by word.  A pair is a leak if some ``window``
aligned words in a row agree in at least ``min_matches`` places; items shorter
than the window must occur in full.

The two masks are chosen so that, whichever two of 13 words are substituted,
one mask fits between the substitutions: the seeds find every pair that the
verification accepts.

Only built-in functions are used.  The hash join broadcasts the benchmark's
hashes if they are measured below ``broadcast_bytes``; a larger benchmark is
shuffle-joined.  Starts in a row with the same hash (a repeated word) are one
span on either side, and two spans that meet name a range of diagonals, so a
word repeated n times over m costs n + m rows and not n x m.  What leaves the
join is one row per document, item and diagonal, so a passage that many
documents share costs one row in each; every diagonal is laid by itself, over
the words of its row alone.

Hits, verification and removal go by a key of the row's own (id and text), so
rows that merely share a doc_id, or have none, do not answer for each other;
only the report of leaked pairs is by doc_id.

Defined cases: null and empty texts hold nothing; an item without words leaks
nowhere; rows equal in doc_id and text are treated alike; repeated items are
reported once; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import BROADCAST_BYTES, let, materialize, row_key, small


@dataclass(frozen=True)
class Seeds:
    #: fixed values: 1 is a word that must agree, 0 is ignored; equal lengths
    masks: tuple[str, ...] = ("11110011", "11010111")
    window: int = 13
    min_matches: int = 11
    broadcast_bytes: int = BROADCAST_BYTES


def text_words(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    split = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(split, lambda w: F.xxhash64(w))


def masked(words: Column, i: Column, mask: str, tag: int) -> Column:
    return F.xxhash64(F.lit(tag), *[F.get(words, i + k) for k, m in enumerate(mask) if m == "1"])


def seed_hashes(words: Column, masks: tuple[str, ...]) -> Column:
    """All hashes of all masks, mask after mask (each has one per start)."""
    span = len(masks[0])

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - span)
        of_mask = lambda t, m: F.transform(starts, lambda i: masked(w, i, m, t))
        return F.concat(*[of_mask(t, m) for t, m in enumerate(masks)])

    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= span, let(words, of)).otherwise(none)


def spans(hashes: Column, starts: Column) -> Column:
    """array<struct<k, last, seed>>: the runs of equal hashes of one mask, of an array with ``starts`` hashes for each mask."""

    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - 1)
        begins = F.filter(at, lambda i: (i % starts == 0) | (F.get(h, i) != F.get(h, i - 1)))
        runs = let(begins, lambda b: F.transform(b, lambda i, n: F.struct(
            i.alias("k"), (F.coalesce(F.get(b, n + 1), F.size(h)) - 1).alias("last"), F.get(h, i).alias("seed"))))
        # most rows repeat no hash at all
        single = F.transform(h, lambda x, i: F.struct(i.alias("k"), i.alias("last"), x.alias("seed")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), single).otherwise(runs)

    none = F.array().cast("array<struct<k:int,last:int,seed:bigint>>")
    return F.when(F.size(hashes) > 0, let(hashes, of)).otherwise(none)


def hash_rows(df: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """One row per span of equal seed hashes: (keep..., pos, last, seed); ``df`` has a ``words`` column."""
    starts = F.col("starts")
    rows = df.select(*keep, (F.size("words") - (len(masks[0]) - 1)).alias("starts"), seed_hashes(F.col("words"), masks).alias("hashes"))
    rows = rows.select(*keep, "starts", F.explode(spans(F.col("hashes"), starts)).alias("s"))
    return rows.select(*keep, (F.col("s.k") % starts).alias("pos"), (F.col("s.last") % starts).alias("last"), F.col("s.seed").alias("seed"))


def short_masks(items: DataFrame, span: int) -> list[tuple[str, ...]]:
    """Full masks for items shorter than the span (at most span - 1 lengths)."""
    lengths = items.where((F.size("words") < span) & (F.size("words") > 0)).select(F.size("words").alias("n")).distinct()
    return [("1" * r["n"],) for r in lengths.orderBy("n").collect()]


def seed_hits(docs: DataFrame, items: DataFrame, seeds: Seeds) -> DataFrame:
    """Distinct (k1, k2, item_id, diagonal, n) that share a seed hash."""
    hits = None
    for masks in [seeds.masks, *short_masks(items, len(seeds.masks[0]))]:
        full = len(masks) == 1 and "0" not in masks[0]
        these = items.where(F.size("words") == len(masks[0])) if full else items
        left = hash_rows(docs, ["k1", "k2"], masks)
        right = materialize(hash_rows(these.withColumn("n", F.size("words")), ["item_id", "n"], masks)
                            .withColumnsRenamed({"pos": "item_pos", "last": "item_last"}), "item-seeds")
        diagonals = F.sequence(F.col("pos") - F.col("item_last"), F.col("last") - F.col("item_pos"))
        found = left.join(small(right, seeds.broadcast_bytes), "seed").select(
            "k1", "k2", "item_id", F.explode(diagonals).alias("diagonal"), "n").distinct()
        hits = found if hits is None else hits.union(found)
    return hits.distinct()


def best_window(agree: Column, k: int) -> Column:
    """The most agreeing places among ``k`` in a row (all, if there are fewer)."""

    def of(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(a) - k, F.lit(0)))
        sums = F.transform(starts, lambda s: F.aggregate(F.slice(a, s + 1, k), F.lit(0), lambda t, x: t + x))
        return F.array_max(sums)

    return let(agree, of)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, k1, k2, text) for every row of ``docs``."""
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))


def leaked_rows(docs: DataFrame, benchmark: DataFrame, seeds: Seeds, doc_id: str, text: str, item_id: str,
                item_text: str) -> DataFrame:
    """(doc_id, k1, k2, item_id, n, best, aligned) for every accepted diagonal of a row and an item."""
    plain = keyed(docs, doc_id, text)
    worded = plain.select("k1", "k2", text_words(F.col("text")).alias("words"))
    items = materialize(benchmark.select(F.col(item_id).alias("item_id"), text_words(F.col(item_text)).alias("words"))
                        .where(F.size("words") > 0).distinct(), "benchmark-words")
    hits = materialize(seed_hits(worded, items, seeds), "seed-hits")
    met = materialize(hits.select("k1", "k2").distinct(), "rows-with-hits")
    # the words of the rows with a hit, once each; rows equal in id and text are one
    words = plain.join(small(met, seeds.broadcast_bytes), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(
        "doc_id", "k1", "k2", text_words(F.col("text")).alias("words"))
    laid = hits.join(materialize(words, "words-with-hits"), ["k1", "k2"])
    under = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.get(F.col("words"), j + F.col("diagonal")))
    pairs = laid.select("doc_id", "k1", "k2", "item_id", "n", under.alias("under"))
    right = items.withColumnRenamed("words", "item_words").withColumnRenamed("item_id", "right_id")
    joined = pairs.join(small(right, seeds.broadcast_bytes), F.col("item_id").eqNullSafe(F.col("right_id")) & (F.size("item_words") == F.col("n")))
    agree = F.zip_with("under", "item_words", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    scored = joined.select("doc_id", "k1", "k2", "item_id", "n", best_window(agree, seeds.window).alias("best"),
                           F.aggregate(agree, F.lit(0), lambda t, x: t + x).alias("aligned"))
    need = F.when(F.col("n") >= seeds.window, seeds.min_matches).otherwise(F.col("n"))
    return scored.where(F.col("best") >= need)


def leaks(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item_words, window_matches, aligned_matches), one row per leaked pair."""
    found = leaked_rows(docs, benchmark, seeds, doc_id, text, item_id, item_text)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("n").cast("long").alias("n_item_words"), F.max("best").cast("long").alias("window_matches"),
        F.max("aligned").cast("long").alias("aligned_matches"))


def clean(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """The rows of ``docs`` that do not leak themselves, all columns kept."""
    found = leaked_rows(docs, benchmark, seeds, doc_id, text, "item_id", "text")
    found = materialize(found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct(), "leaked-rows")
    k1, k2 = row_key(docs[doc_id], docs[text])
    return docs.join(small(found, seeds.broadcast_bytes), (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")
