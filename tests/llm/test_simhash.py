import itertools
import random
import re

import numpy as np
import xxhash

from roadpulse.llm import queries, simhash
from roadpulse.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """(doc_id, fp) -> component id by comparing all pairs."""
    fps = sorted({fp for _, fp in pairs})
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            up[root(a)] = root(b)
    least = {}
    for d, fp in pairs:
        if d is not None:
            least[root(fp)] = min(d, least.get(root(fp), d))
    return {fp: least.get(root(fp)) for fp in fps}


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    pairs = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    comp = plain_components(pairs)
    want = sorted((d, f"{fp:016x}", comp[fp]) for d, fp in pairs)
    assert sorted(map(tuple, queries.op9_simhash(spark, SF).collect())) == want


def prints(rng, n):
    """Random fingerprints with families of one to six flipped bits, near and far."""
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            out.append(x)
    return out


def check(spark, fps, opts):
    rows = [(i, int(np.array(f, dtype=np.uint64).view(np.int64))) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.fingerprint_components(df, opts).collect()}
    want = plain_components(list(enumerate(fps)))
    assert {f % (1 << 64): c for f, c in got.items()} == want


def test_components_of_random_families(spark):
    check(spark, prints(random.Random(1), 400), simhash.SimHash())


def test_errors_in_every_segment(spark):
    rng, fps = random.Random(2), []
    for _ in range(200):
        x = rng.getrandbits(64)
        bits = [rng.randrange(23), rng.randrange(23, 46), rng.randrange(46, 64)]
        bits.append(rng.choice([b for b in range(64) if b not in bits]))
        y = x
        for b in bits:
            y ^= 1 << b
        fps += [x, y]
    check(spark, fps, simhash.SimHash())


def test_long_runs_are_dealt_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    near = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(900)}
    monkeypatch.setattr(simhash, "HOT_SAMPLE", 2)
    check(spark, sorted(near) + prints(rng, 50), simhash.SimHash(max_run=40))


def test_golay_decoding():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 23, 2000)
    words = simhash.decode(values) << 11
    words |= simhash.REMAINDERS[words >> 11]
    assert np.bitwise_count(values ^ words).max() <= 3
    a = rng.integers(0, 1 << 23, 500)
    b = a ^ (1 << rng.integers(0, 23, 500)) ^ (1 << rng.integers(0, 23, 500))
    for x, y in zip(a, b):
        assert set(simhash.fuzzy(np.array([x]))[1]) & set(simhash.fuzzy(np.array([y]))[1])
    assert set(np.bincount(simhash.fuzzy(values)[0])) <= {1, 6}


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    pairs = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    comp = plain_components(pairs)
    found = simhash.grouped(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.fp % (1 << 64), r.component_id or 0) for r in found) == sorted((d or 0, fp, comp[fp] or 0) for d, fp in pairs)
    assert simhash.grouped(no_docs).count() == 0
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert len(kept.collect()) == len({(c, fp if c is None else 0) for (d, fp) in pairs for c in [comp[fp]]})
    assert simhash.one_of_each(no_docs).count() == 0


def test_one_row_of_each_component_under_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"w{rng.getrandbits(30)}" for _ in range(60)) for _ in range(4))
    rows = [(5, a), (5, b), (9, b), (3, c), (5, c), (None, c), (None, d), (None, d), (None, None), (7, a), (4, "")]
    pairs = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components(pairs)
    assert [comp[f] for _, f in pairs] == [5, 5, 5, 3, 3, 3, None, None, 4, 5, 4]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(5, a), (5, b), (3, c), (0, d), (4, "")])


def test_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, k) for k in range(2000, 2300)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 1000: 1000, **{k: 1000 for k in range(2000, 2300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
