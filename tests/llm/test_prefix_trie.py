"""Prefix trie against a dictionary of all prefixes."""
import hashlib
import random
import zlib

import pytest

from roadpulse.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes of the contract, from plain dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    tok = lambda t: hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()
    own = {c: [x[2:] for x in sorted(v, key=lambda t: (t[0], t[1], tok(t)))] for c, v in own.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        anchor = c - (c % 100 if c >= 0 else -(-c % 100))
        convs[c] = own.get(anchor, [])[:h] + own[c][h:]
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for p, m in members.items():
        kids = [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p]
        below = [q for q in members if q[:len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed=3, n=60):
    """Conversations that share beginnings, with nulls, ties, repeated rows and ends inside others' ways."""
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, n), 100, 101, 117, 205, 206, -3, -100, -105]:
        for t in range(rnd.choice((1, 2, 3, 5, 7, 9))):
            rows.append((c, rnd.choice((t, t, None)), rnd.choice(("user", None)), rnd.choice(("a", "bé", "", None)) if t else rnd.choice(("hi", "ho"))))
    rows += rows[:5] + [(None, 1, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("size,paths", [(256, 50_000), (2, 7), (3, 5)])
def test_trie_equals_all_prefixes(spark, monkeypatch, size, paths):
    """In one range and many, and with segments so short that tries hang on tries."""
    monkeypatch.setattr(T, "RANGE_PATHS", paths)
    monkeypatch.setattr(T, "PIECE", 20)
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "'x' AS path", "2 AS level", "3 AS root", "4 AS n").repartition(3)
    got = T.trie_of(df, size=size)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_no_conversations_and_no_turns(spark):
    assert T.trie_of(spark.createDataFrame([], SCHEMA)).count() == 0
    # crc32("11") % 6 is above its one turn, and there is no conversation 0: the root alone
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    got = [tuple(r) for r in T.trie_of(spark.createDataFrame([(alone, 1, "user", "x")], SCHEMA)).collect()]
    assert got == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_z_fast_lookup_agrees_with_all_prefixes():
    """Exit nodes by fat binary search are those of a walk, whatever the order of insertion."""
    rnd = random.Random(5)
    step = lambda x: x.to_bytes(T.STEP, "big")
    for _ in range(30):
        paths = list({tuple(rnd.choice((1, 2)) for _ in range(rnd.randrange(0, 12))) for _ in range(25)})
        rnd.shuffle(paths)
        coded = [b"".join(map(step, p)) for p in paths]
        trie = T.ZFastTrie()
        for at in range(0, len(coded), 4):
            for path, node in zip(coded[at:at + 4], trie.insert_batch(coded[at:at + 4])):
                assert node.path[:node.hi * T.STEP] == path
        for path in coded:
            assert trie.locate(path, trie.root)[0].hi * T.STEP == len(path)
        assert len(set(map(id, trie.handles.values()))) == len(trie.handles)
