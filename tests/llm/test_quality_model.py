"""Quality classifier against plain Python: votes, posteriors and the scorer's features."""
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from roadpulse.llm import quality_model as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    t = text or ""
    words = WORD.findall(t)
    solid = sum(map(len, words))
    share = lambda chars: sum(c in chars for c in t) / solid if solid else None
    lines = [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")]
    lines = [raw for raw, x in zip(t.split("\n"), lines) if x]
    clean = sum(bool(re.fullmatch(r"[^\W\d_]+[.,;:?)]?", w)) for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w)
    return {
        "m_words": len(words), "m_symbols": share("#*$%&|<>{}[]\\^~_=+@"), "m_capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "m_shouts": share("!"),
        "m_clean": clean / len(words) if words else None,
        "m_again": sum(a == b for a, b in zip(words, words[1:])) / len(words) if words else None,
        "m_variety": len(set(words)) / math.sqrt(len(words)) if len(words) >= 25 else None,
        "m_length": solid / len(words) if words else None, "m_lines": len(set(lines)) / len(lines) if lines else None,
    }


class Value:
    """Stands in for a column: comparisons of a number, false where it is null."""

    def __init__(self, x):
        self.x = x

    def __lt__(self, y):
        return self.x is not None and self.x < y

    def __gt__(self, y):
        return self.x is not None and self.x > y

    def __ge__(self, y):
        return self.x is not None and self.x >= y

    def between(self, a, b):
        return self.x is not None and a <= self.x <= b


def plain_pattern(text):
    m = plain_measures(text)
    return "".join("-" if bad(Value(m[name])) else "+" if good(Value(m[name])) else "0" for name, bad, good in M.LABELLERS.values())


def plain_em(patterns, counts, opts):
    """The two-class labeller model, by loops over patterns and labellers."""
    post = [0.1 if "-" in p else 0.9 for p in patterns]
    for _ in range(opts.rounds):
        odds = []
        shares = []
        for side in (0, 1):
            w = [n * (g if side == 0 else 1 - g) for n, g in zip(counts, post)]
            rows = []
            for k in range(len(M.LABELLERS)):
                votes = [sum(x for x, p in zip(w, patterns) if p[k] == v) + opts.smoothing for v in "+-"]
                rows.append([v / sum(votes) for v in votes])
            shares.append(rows)
            odds.append(sum(w) + opts.smoothing)
        for k in range(len(M.LABELLERS)):
            if shares[0][k][0] < shares[1][k][0]:
                shares[0][k] = shares[1][k] = [(a + b) / 2 for a, b in zip(shares[0][k], shares[1][k])]
        prior = odds[0] / (sum(counts) + 2 * opts.smoothing)
        new = []
        for p in patterns:
            log = [sum(math.log(s[k]["+-".index(v)]) for k, v in enumerate(p) if v != "0") for s in shares]
            new.append(1 / (1 + math.exp(min(max(log[1] + math.log(1 - prior) - log[0] - math.log(prior), -500), 500))))
        change = max(abs(a - b) for a, b in zip(new, post))
        post = new
        if change < 1e-9:
            break
    return dict(zip(patterns, post))


def test_votes_equal_plain_rules(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = M.voted(docs, "doc_id", "text").collect()
    assert len({r.pattern for r in rows}) > 20
    assert [r.pattern for r in rows] == [plain_pattern(r.text) for r in rows]


def test_posteriors_equal_plain_expectation_maximisation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = Counter(plain_pattern(r.text) for r in docs.collect())
    patterns = sorted(held)
    got, _ = M.expectation_maximisation(patterns, [held[p] for p in patterns], M.Quality())
    want = plain_em(patterns, [held[p] for p in patterns], M.Quality())
    assert all(abs(got[p] - want[p]) < 1e-6 for p in patterns)


def test_copies_weigh_like_rows(spark):
    """The fit on texts with their numbers is the fit on all rows."""
    from pyspark.ml.functions import vector_to_array
    text = lambda i: " ".join(f"w{(i * k) % 37}" for k in range(12))
    rows = [(text(i), 0.9 if i % 2 else 0.2, 1 + i % 4) for i in range(40)]
    counted = spark.createDataFrame(rows, "text string, posterior double, n long")
    single = counted.select("text", "posterior", F.explode(F.array_repeat(F.lit(1).cast("long"), F.col("n").cast("int"))).alias("n"))
    opts = M.Quality()
    scores = []
    for df in (counted, single):
        model = M.fitted(M.hashed(df, opts), opts)
        found = model.transform(M.hashed(counted, opts)).select("text", vector_to_array("probability")[1].alias("p")).collect()
        scores.append({r.text: r.p for r in found})
    assert all(abs(scores[0][t] - scores[1][t]) < 1e-3 for t in scores[0])
