"""Weak-label quality classifier (operator 1).

1. Overlapping heuristic labellers vote good, bad or abstain on every document.
2. Expectation-maximisation (the two-class labeller model with abstentions,
   labellers independent given the class) estimates each labeller's accuracy
   from how often each pattern of votes occurs.  The patterns are the sufficient
   statistic: documents are counted by pattern over the whole table, at most
   3 ** labellers rows whatever the input, and only those counts reach the driver.
3. Each pattern's posterior probability of "good" becomes its documents' soft label, and a logistic regression over hashed features (words, and the
   words' shapes) is fitted to it.  It is fitted on about ``fit_rows`` documents,
   chosen by hash of the id: a documented bound on the fit alone.
4. The fitted scorer is applied to every whole document.

A document is kept if its score is at least ``threshold``.

Defined cases: null and empty texts get votes like any other (too few words is
a vote for bad) and are scored; null ids and repeated rows are scored each; an
empty table gives an empty result; a table without enough rows of either class
to fit on is scored by the mean posterior; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import WHITE_CHARS, count_of, let, materialize, solid_chars, white_words

@dataclass(frozen=True)
class Quality:
    fit_rows: int = 20_000
    features: int = 1 << 15
    rounds: int = 200
    smoothing: float = 1.0
    regularisation: float = 1e-6
    iterations: int = 30
    threshold: float = 0.5


def measures(text: Column, words: Column, solid: Column) -> dict[str, Column]:
    """Counts over the whole text; ratios are null where undefined."""
    t = F.coalesce(text, F.lit(""))
    share = lambda chars: F.when(solid > 0, count_of(t, chars) / solid)
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(WHITE_CHARS)) != "")
    some, many = F.size(words) > 0, F.size(words) >= 25
    again = let(words, lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))))
    return {
        "m_words": F.size(words),
        "m_symbols": share(r"#*$%&|<>{}\[\]\\^~_=+@"),
        "m_capitals": share("A-Z"),
        "m_shouts": share("!"),
        "m_clean": F.when(some, F.regexp_count(t, F.lit(r"(?<!\S)\p{L}+[.,;:?)]?(?!\S)")) / F.size(words)),
        "m_again": F.when(some, again / F.size(words)),
        "m_variety": F.when(many, F.size(F.array_distinct(words)) / F.sqrt(F.size(words))),
        "m_length": F.when(some, solid / F.size(words)),
        "m_lines": let(lines, lambda x: F.when(F.size(x) > 0, F.size(F.array_distinct(x)) / F.size(x))),
    }


#: labeller: (measure, votes bad if, votes good if); a null measure abstains
LABELLERS = {
    "length": ("m_words", lambda m: m < 1, lambda m: m >= 50),
    "symbols": ("m_symbols", lambda m: m > 0.05, lambda m: m < 0.005),
    "clean_words": ("m_clean", lambda m: m < 0.6, lambda m: m > 0.9),
    "capitals": ("m_capitals", lambda m: m > 0.3, lambda m: m < 0.1),
    "shouts": ("m_shouts", lambda m: m > 0.03, lambda m: m < 0.005),
    "again": ("m_again", lambda m: m > 0.1, lambda m: m < 0.02),
    # distinct words grow with the square root of the length in prose; a repeated word falls far below
    "variety": ("m_variety", lambda m: m < 1.5, lambda m: m > 3),
    "word_length": ("m_length", lambda m: (m < 2.5) | (m > 12), lambda m: m.between(3, 9)),
    "lines": ("m_lines", lambda m: m < 0.5, lambda m: m > 0.9),
}


def voted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, pattern): all labellers' votes as one string of +, -, and 0."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"words": white_words(F.col("text")), "solid": solid_chars(F.col("text"))})
    rows = rows.withColumns(measures(F.col("text"), F.col("words"), F.col("solid")))
    signs = [F.when(bad(F.col(m)), "-").when(good(F.col(m)), "+").otherwise("0") for m, bad, good in LABELLERS.values()]
    return rows.select("doc_id", "text", F.concat(*signs).alias("pattern"))


def expectation_maximisation(patterns: list[str], counts: list[int], opts: Quality) -> tuple[dict[str, float], dict]:
    """Posterior of "good" for each pattern, and the fitted model.

    Runs on pattern counts only.  Each labeller has, for either class, the
    probability of each vote it casts (an abstention says nothing); they start from the belief that labellers
    are right more often than wrong (a document with any bad vote starts as bad)."""
    table = np.array([[{"+": 0, "0": 1, "-": 2}[v] for v in p] for p in patterns])
    n = np.array(counts, dtype=float)
    hot = (table[:, :, None] == np.array([0, 2])).astype(float)
    good = np.where(hot[:, :, 1].any(axis=1), 0.1, 0.9)
    for _ in range(opts.rounds):
        weights = (n * good, n * (1 - good))
        shares = np.stack([np.einsum("p,plv->lv", w, hot) + opts.smoothing for w in weights])
        shares /= shares.sum(axis=2, keepdims=True)
        # a labeller that would be worse than chance in one class says nothing
        odd = shares[0, :, 0] < shares[1, :, 0]
        shares[:, odd] = shares[:, odd].mean(axis=0)
        log = np.einsum("plv,clv->cp", hot, np.log(shares))
        prior = (weights[0].sum() + opts.smoothing) / (n.sum() + 2 * opts.smoothing)
        new = 1 / (1 + np.exp(np.clip(log[1] + math.log(1 - prior) - log[0] - math.log(prior), -500, 500)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    model = {name: {"good": shares[0, i].tolist(), "bad": shares[1, i].tolist()} for i, name in enumerate(LABELLERS)}
    return dict(zip(patterns, good.tolist())), {"prior_good": float(prior), "labellers": model}


def token_features(text: Column) -> Column:
    """Words, and their shapes (letter runs become a, capitals A, digits 0)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    shape = F.coalesce(text, F.lit(""))
    for pattern, to in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")):
        shape = F.regexp_replace(shape, pattern, to)
    return F.concat(white_words(t), F.transform(white_words(shape), lambda s: F.concat(F.lit("\t"), s)))


def hashed(rows: DataFrame, opts: Quality) -> DataFrame:
    rows = rows.withColumn("tokens", token_features(F.col("text")))
    tf = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=opts.features)
    return Normalizer(inputCol="counts", outputCol="features").transform(tf.transform(rows)).drop("tokens", "counts")


def scored(docs: DataFrame, opts: Quality = Quality(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, kept) for every row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    share = min(1.0, opts.fit_rows / max(docs.count(), 1))
    # by id and text, so that rows without an id, or with the same, are chosen one by one
    chosen = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000)
    marks = voted(rows, "doc_id", "text").select("pattern", F.when(chosen, F.coalesce("text", F.lit(""))).alias("text"))
    marks = materialize(marks, "vote-patterns")
    counts = marks.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** labellers rows
    if not counts:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    posterior, _ = expectation_maximisation([r["pattern"] for r in counts], [r["count"] for r in counts], opts)
    labels = docs.sparkSession.createDataFrame(list(posterior.items()), "pattern string, posterior double")
    # equal texts are one row with their number as weight: a group of copies does not pass the bound
    fit = marks.where(F.col("text").isNotNull()).groupBy("pattern", "text").agg(F.count(F.lit(1)).alias("n"))
    fit = fit.join(F.broadcast(labels), "pattern")  # bounded like the counts
    model = fitted(materialize(hashed(fit, opts).select("features", "posterior", "n"), "fit-rows"), opts)
    if model is None:
        mean = sum(posterior[r["pattern"]] * r["count"] for r in counts) / sum(r["count"] for r in counts)
        good = F.lit(float(mean))
        return rows.select("doc_id", good.alias("score"), (good >= opts.threshold).alias("kept"))
    good = vector_to_array(F.col("probability"))[1]
    return model.transform(hashed(rows, opts)).select("doc_id", good.alias("score")).withColumn("kept", F.col("score") >= opts.threshold)


def fitted(rows: DataFrame, opts: Quality):
    """Logistic regression on soft labels: each row counts as good with its posterior and as bad with the rest."""
    both = rows.select("features", F.lit(1.0).alias("label"), (F.col("posterior") * F.col("n")).alias("weight")).union(
        rows.select("features", F.lit(0.0).alias("label"), ((1 - F.col("posterior")) * F.col("n")).alias("weight"))).where("weight > 0")
    if both.select("label").distinct().count() < 2:
        return None
    lr = LogisticRegression(weightCol="weight", regParam=opts.regularisation, maxIter=opts.iterations, standardization=True)
    return lr.fit(both)
