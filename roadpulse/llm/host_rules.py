"""Quality rules with host verdicts (operator 5).

Every document gets countable features and a base verdict.  The base failures
are then aggregated by host; each host's failure rate is shrunk towards the
corpus rate with a beta prior fitted to the hosts themselves (method of
moments), so that a host with two failed pages is not condemned while one with
thousands is.  Hosts whose shrunk rate is above ``max_host_rate`` are rejected
and the verdict is joined back to their documents.

Only built-in column functions are used.  A document is processed inside its
row: nothing at word grain is shuffled.  The host table is one pre-aggregated
row per host (a host with a third of all rows costs one partial row per input
partition), and only rejected hosts are joined back.

Defined cases: null or empty text has no words and fails the base rules; a null
host is judged by the base rules only and does not enter the prior; repeated
rows are judged each; an empty table gives an empty result; other columns are
ignored by ``judged`` and passed through untouched by ``accepted``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import BROADCAST_BYTES, WHITE_CHARS, count_of, let, materialize, small, solid_chars, white_words

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"  # the inside of a character class


@dataclass(frozen=True)
class HostRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_host_rate: float = 0.5
    #: prior strength (pseudo-documents) when the hosts show no more spread than chance
    max_strength: float = 1e6
    min_strength: float = 1.0
    broadcast_bytes: int = BROADCAST_BYTES


def covered_words(words: Column, k: int) -> Column:
    """Words that lie in a ``k``-word window found at least twice in the same text.

    Windows are compared by 64-bit hash within one document.  Most documents
    repeat none, which the distinct count shows without sorting."""

    def union_length(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(starts, j + 1) - p, F.lit(k))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated(pairs: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(pairs, lambda x, j: same(j - 1, x) | same(j + 1, x))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), union_length)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, repeated))

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - k)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])), of_hashes)

    return F.when(F.size(words) >= k, let(words, of_words)).otherwise(F.lit(0))


def with_features(df: DataFrame, text: str, rules: HostRules, prefix: str = "") -> DataFrame:
    """``df`` plus the feature columns and ``base_failed`` (names after ``prefix``)."""
    t, w = F.coalesce(F.col(text), F.lit("")), F.col(f"{prefix}words")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(WHITE_CHARS)) != "")
    df = df.withColumn(f"{prefix}words", white_words(F.col(text)))
    df = df.withColumns({
        f"{prefix}n_words": F.size(w).cast("long"),
        f"{prefix}word_chars": solid_chars(t).cast("long"),
        f"{prefix}n_symbols": count_of(t, SYMBOLS).cast("long"),
        f"{prefix}n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        f"{prefix}n_repeat_words": covered_words(w, rules.window).cast("long"),
    }).drop(f"{prefix}words")
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return df.withColumn(f"{prefix}base_failed", (n < rules.min_words) | (100 * r > rules.max_repeat_percent * n))


def host_table(df: DataFrame, host: str, failed: str, rules: HostRules) -> DataFrame:
    """(host, n, f, shrunk_rate, rejected): one row per non-null host."""
    hosts = (df.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("f")))
    a, b = beta_prior(hosts, rules)
    rate = (F.col("f") + a) / (F.col("n") + (a + b))
    return hosts.withColumn("shrunk_rate", rate).withColumn("rejected", F.col("shrunk_rate") > rules.max_host_rate)


def beta_prior(hosts: DataFrame, rules: HostRules) -> tuple[float, float]:
    """Beta parameters by the method of moments over (n, f) of all hosts: the
    spread of the rates beyond binomial chance gives the prior's strength."""
    n, f = F.col("n").cast("double"), F.col("f").cast("double")
    s = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("f").alias("f"),
                  F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ffn")).first()
    if not s["n"]:
        return 1.0, 1.0
    mean = s["f"] / s["n"]
    chance = mean * (1 - mean)
    free = s["n"] - s["nn"] / s["n"]
    spread = (s["ffn"] - s["n"] * mean * mean - (s["k"] - 1) * chance) / free if free > 0 else 0.0
    strength = rules.max_strength if spread <= 0 else chance / spread - 1
    strength = min(max(strength, rules.min_strength), rules.max_strength)
    return mean * strength, (1 - mean) * strength


def rejected_hosts(df: DataFrame, host: str, failed: str, rules: HostRules) -> DataFrame:
    hosts = materialize(host_table(df, host, failed, rules).where("rejected").select("host"), "rejected-hosts")
    return small(hosts.withColumn("host_rejected", F.lit(True)), rules.broadcast_bytes)


def judged(docs: DataFrame, rules: HostRules = HostRules(), doc_id: str = "doc_id", text: str = "text",
           host: str = "source") -> DataFrame:
    """(doc_id, features, base_failed, kept) for every row of ``docs``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    own = materialize(with_features(own, "text", rules).drop("text"), "rule-features")
    bad = rejected_hosts(own, "host", "base_failed", rules)
    kept = ~F.col("base_failed") & F.col("host_rejected").isNull()
    return own.join(bad, "host", "left").select("doc_id", *FEATURES, "base_failed", kept.alias("kept"))


def accepted(docs: DataFrame, rules: HostRules = HostRules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.  Documents that
    pass the base rules are written once beside the rows' verdicts, so the text
    is analysed once and never shuffled unless very many hosts are rejected."""
    flagged = with_features(docs, text, rules, "__rule_")
    flagged = materialize(flagged.select(*docs.columns, "__rule_base_failed"), "rule-flags")
    bad = rejected_hosts(flagged, host, "__rule_base_failed", rules).withColumnRenamed("host", "__rule_host")
    return (flagged.where(~F.col("__rule_base_failed"))
            .join(bad, F.col(host) == F.col("__rule_host"), "left_anti").select(*docs.columns))
