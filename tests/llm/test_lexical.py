"""Ranked lexical search against a plain loop over documents."""
import math
import re

import pytest

from roadpulse.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def brute(docs, items, k=10):
    bags = [(i, words(t)) for i, t in docs]
    held = [b for _, b in bags if b]
    n_docs, length = len(held), sum(map(len, held))
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(words(t))
    out = []
    for item, own in terms.items():
        rows = []
        for doc, bag in bags:
            score = 0
            for t in own:
                if tf := bag.count(t):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in b for b in held) + 1)))
                    m = 10 + 90 * len(bag) * n_docs // length
                    score += w * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta, gamma!"), (1, "one more text of item 1"), (2, "nothing-of-this äÖ"), (None, "beta w5 w7"), (3, None), (4, ""), (5, "x1 x2 x3 w1")]


@pytest.mark.parametrize("most", [200_000, 3])
def test_ranking_equals_brute_force(spark, odd_docs, most):
    """Nulls, empty and long texts, repeated rows and ties; in one block of items and in several."""
    more = [(100 + i, f"beta w{i % 3} ÄÖ äÖ tie" if i % 2 else "ALPHA beta gamma beta", "en", "a", 1) for i in range(40)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string, l string, s string, n long").select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    got = lexical.ranked(odd_docs.unionByName(docs.where("doc_id >= 100"), allowMissingColumns=True),
                         spark.createDataFrame(ITEMS, "item_id long, text string"), most_postings=most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, ITEMS)


def test_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked(no_docs, items).count() == 0
    assert lexical.ranked(odd_docs, items.limit(0)).count() == 0


def test_terms_split_at_ascii_marks_only():
    text = "Ünïts\x7f A-b_c 9² \x1c“quoted” ÄB"
    assert [t.decode() for t in lexical.terms(text.encode())] == words(text)


def test_equal_hashes_of_different_bags_stay_apart(spark, monkeypatch):
    """Classes are told apart by bag and m where every hash is the same."""
    monkeypatch.setattr(lexical, "class_key", lambda: [lexical.F.lit(1).cast("long").alias("hash"), lexical.F.col("m"), lexical.F.col("bag")])
    docs = [(i, t) for i, t in enumerate(["beta w5"] * 12 + ["beta"] * 15 + ["w7 w7 beta"] * 3)]
    items = [(1, "beta w5 w7")]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)
