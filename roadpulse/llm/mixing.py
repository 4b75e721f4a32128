"""Mixing sources to target weights (operator 8).

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and
share ``volume`` times all sizes; a source's target stops at ``max_epochs``
times its size and the excess goes to the others by weight.

Selection without sorting documents: a document is taken ``floor(target/size)``
times, and once more if its hash lies under the source's threshold.  The
threshold is found by histograms: sizes are summed by source and leading hash
digit, the running sum over at most ``2**digit_bits`` buckets shows the bucket
in which the remaining budget ends, and only the documents of that bucket enter
the next, finer histogram.  The digits of the id's hash come first, then those
of the text's hash, so that rows without an id, or of one repeated id, are told
apart.  After the last digit the boundary is one pair of hashes, whose rows are
taken if that brings the source nearer to its target.  Thresholds of smaller budgets are nested in those of larger ones.

A hot source is pre-aggregated to its buckets before the shuffle; the running
sum window holds at most ``2**digit_bits`` rows.  The boundary tables have one
row per source and are joined by source (broadcast only if counted small).

Defined cases: null text has size 0; null source is a source of its own; rows
equal in doc_id and text share their hashes and are taken or left together at
the boundary; sources of size 0 have target 0; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.llm.common import BROADCAST_BYTES, materialize, small, white_words


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    volume: float = 1.5
    max_epochs: int = 2
    digit_bits: int = 15
    digits: int = 4
    broadcast_bytes: int = BROADCAST_BYTES


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id's text (null: of the empty text), as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def text_hash(text: Column) -> Column:
    """60 bits of the text's hash (null: of the empty text), as a long."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 4)


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target, base, budget), one row per source.

    The level at which capped targets fill up is found in rounds: sources whose
    share exceeds their cap are fixed at the cap and the rest share again.  A
    round is an aggregate of the one-row-per-source table; sources only ever
    move to the capped side, and in practice a handful of rounds suffice."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.array(*[F.lit(w) for w in mix.weights])
    rank = (F.row_number().over(order) - 1) % len(mix.weights)
    src = materialize(src.withColumn("weight", F.get(weight, rank.cast("int")).cast("long")), "mix-sources")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * mix.max_epochs, -1.0, F.lit(False)
    while True:
        s = src.agg(F.sum(F.when(capped, cap).otherwise(0)).alias("fixed"),
                    F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not s["open"]:
            break
        new = (mix.volume * total - s["fixed"]) / s["open"]
        if new == level:
            break
        level, capped = new, F.col("weight") * F.lit(new) >= cap
    target = F.when(capped, cap.cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    src = src.withColumn("target", target)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    src = src.withColumn("base", F.least(base.cast("long"), F.lit(mix.max_epochs)))
    return src.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))


def thresholds(docs: DataFrame, src: DataFrame, mix: Mix) -> DataFrame:
    """(source, threshold, text_threshold): pairs of hashes up to and including it
    get one more copy; no row means none, a text threshold of -1 none of the
    boundary id.  One histogram per digit over the boundary bucket."""
    bits = mix.digit_bits * mix.digits
    bounds = src.where("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("prefix"),
                        F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("threshold"))
    for column in ("hash", "text_hash"):
        for level in range(mix.digits):
            shift = bits - mix.digit_bits * (level + 1)
            bounds = small(materialize(bounds, f"mix-bounds-{column}-{level}"), mix.broadcast_bytes)
            digit = F.shiftright(column, shift)
            at = F.col("src").eqNullSafe(F.col("source")) & (F.shiftright(column, shift + mix.digit_bits) == F.col("prefix"))
            if column == "text_hash":
                at &= F.col("hash") == F.col("threshold")
            inside = docs.withColumnRenamed("source", "src").join(bounds, at)
            hist = inside.groupBy("source", "budget", "before", "threshold", digit.alias("bucket")).agg(F.sum("size").alias("size"))
            upto = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
            hist = hist.withColumn("upto", upto).where(F.col("upto") >= F.col("budget"))
            edge = hist.groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "budget", "threshold")).alias("e"))
            bounds = edge.select("source", F.col("e.budget").alias("budget"), F.col("e.bucket").alias("prefix"),
                                 (F.col("e.upto") - F.col("e.size")).alias("before"), F.col("e.threshold").alias("threshold"),
                                 F.col("e.size").alias("edge"))
        if column == "hash":
            bounds = bounds.select("source", "budget", F.lit(0).cast("long").alias("prefix"), "before", F.col("prefix").alias("threshold"))
    over = F.col("before") + F.col("edge") - F.col("budget")
    under = F.col("budget") - F.col("before")
    return bounds.select("source", "threshold",
                         F.when(over < under, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("text_threshold"))


def mixed(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) for every row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), doc_hash(F.col(doc_id)).alias("hash"),
                      text_hash(F.col(text)).alias("text_hash"), F.size(white_words(F.col(text))).cast("long").alias("size"))
    own = materialize(own, "mix-sizes")
    plan = source_plan(own, mix)
    joined = own.withColumnRenamed("source", "src").join(plan, F.col("src").eqNullSafe(F.col("source")), "left")
    copies = F.col("base") + once_more(F.col("hash"), F.col("text_hash"), F.col("threshold"), F.col("text_threshold"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                         F.col("src").alias("source"), copies.alias("copies"))


def source_plan(own: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target, base, threshold, text_threshold), written and hinted if small."""
    src = materialize(source_targets(own, mix), "mix-targets")
    edge = thresholds(own, src, mix).withColumnRenamed("source", "edge_source")
    plan = src.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").select(
        "source", "source_size", "target", "base", F.coalesce("threshold", F.lit(-1)).alias("threshold"),
        F.coalesce("text_threshold", F.lit(-1)).alias("text_threshold"))
    return small(materialize(plan, "mix-plan"), mix.broadcast_bytes)


def once_more(hashed: Column, texts: Column, threshold: Column, text_threshold: Column) -> Column:
    """1 for the rows whose hashes lie under the source's boundary or on it."""
    return ((hashed < threshold) | ((hashed == threshold) & (texts <= text_threshold))).cast("long")


def take(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text",
         source: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns kept."""
    own = docs.select(F.col(source).alias("source"), doc_hash(F.col(doc_id)).alias("hash"),
                      text_hash(F.col(text)).alias("text_hash"), F.size(white_words(F.col(text))).cast("long").alias("size"))
    plan = source_plan(materialize(own, "mix-sizes"), mix)
    plan = plan.select(F.col("source").alias("__mix_source"), F.col("base").alias("__mix_base"),
                       F.col("threshold").alias("__mix_threshold"), F.col("text_threshold").alias("__mix_text_threshold"))
    copies = F.col("__mix_base") + once_more(doc_hash(F.col(doc_id)), text_hash(F.col(text)), F.col("__mix_threshold"),
                                             F.col("__mix_text_threshold"))
    joined = docs.join(plan, docs[source].eqNullSafe(F.col("__mix_source")), "left").withColumn("__mix_copies", copies)
    repeated = F.explode(F.array_repeat(F.lit(True), F.col("__mix_copies").cast("int")))
    return joined.select(*docs.columns, repeated.alias("__mix_row")).select(*docs.columns)
