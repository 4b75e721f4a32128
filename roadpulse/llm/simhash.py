"""SimHash near-duplicates with Golay-code fuzzy keys (operator 9).

Fingerprint: words are lower-cased (A-Z) and split at white space; every run of
four words, joined by spaces, is hashed with XXH64 (seed 42); a bit is set if it
is set in over half of the hashes.  A text with fewer words is one shingle, one
without words has fingerprint zero.  Fingerprints link at four or fewer
differing bits; a component is what links reach.

Keys: a fingerprint is cut into segments A (23 bits), B (23) and C (18).  The
binary Golay code [23,12,7] is perfect, so any 23-bit value decodes to one
codeword; decoding a value and its 23 one-bit neighbours gives one codeword
index, or six.  Two values that differ in at most two bits have a neighbour in
common, hence an index.  The at most four errors between linked fingerprints
fall on the segments in one of two ways:

* some segment has none: of the others one has at most two, so the pair shares
  (exact segment, index of another segment);
* every segment has one or two: A and B share an index each, and one of C's
  three 6-bit parts is equal, so the pair shares (index A, index B, part of C).

The first kind of key goes first.  Its links are contracted to components, and
the second kind then looks only for links between different components.  Rows
are joined by key (a shuffle, sorted by key); each run of equal keys is
verified by bit distance in numpy, and a run yields a spanning forest of its
links rather than all its pairs.  A key whose run would be long (estimated from
one fingerprint in ``HOT_SAMPLE``) is dealt to tasks as blocks of chunk pairs,
which together still compare every pair.

Defined cases: null and empty text have fingerprint zero and link like any
other; equal texts and repeated rows share a fingerprint and a component; the
component id is the smallest non-null doc_id (null if there is none); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import give_back, materialize, row_key
from roadpulse.llm.components import components

SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0b101011100011
HOT_SAMPLE = 64


@dataclass(frozen=True)
class SimHash:
    shingle: int = 4
    max_bits: int = 4
    #: fingerprints under one key that one task compares
    max_run: int = 40_000


# ---- fingerprints ---------------------------------------------------------------

def fingerprint(text: str | None, k: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k, n, ones = min(k, len(words)), max(len(words) - k + 1, 1), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        part = words[at:min(at + 65536, n) + k - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*[part[i:] for i in range(k)])]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, doc_id: str, text: str, k: int, more: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, fp, more...): the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, k) for t in texts], dtype=np.uint64)
        give_back()
        return pd.Series(found.view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), prints(F.col(text)).alias("fp"), *more)


# ---- Golay keys -----------------------------------------------------------------

def _remainders() -> np.ndarray:
    """Remainder modulo the generator of each 12-bit message shifted by 11."""
    r = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - 11), 0)
    return r


REMAINDERS = _remainders()


def _errors() -> np.ndarray:
    """The error pattern of weight three or less that belongs to each syndrome."""
    one = 1 << np.arange(23, dtype=np.int64)
    two = (one[:, None] ^ one[None, :]).ravel()
    three = (two[:, None] ^ one[None, :]).ravel()
    table = np.zeros(2048, dtype=np.int64)
    for patterns in (three, two, one, np.zeros(1, dtype=np.int64)):  # lighter patterns come last and win
        light = patterns[np.bitwise_count(patterns) <= 3]
        table[REMAINDERS[light >> 11] ^ (light & 2047)] = light
    return table


ERRORS = _errors()


def decode(values: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit value."""
    return (values ^ ERRORS[REMAINDERS[values >> 11] ^ (values & 2047)]) >> 11


def fuzzy(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the one or six codeword indices of each value's neighbourhood."""
    near = np.concatenate([np.zeros(1, dtype=np.int64), 1 << np.arange(23, dtype=np.int64)])
    found = np.sort(decode(values[:, None] ^ near[None, :]), axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    row, col = np.nonzero(fresh)
    return row, found[row, col]


def segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def exact_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for pairs that agree in a whole segment."""
    seg, rows, keys = segments(fp), [], []
    for fuzz in range(3):
        row, index = fuzzy(seg[fuzz])
        for exact in range(3):
            if exact != fuzz:
                rows.append(row)
                keys.append((exact * 3 + fuzz << 35) | (seg[exact][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def spread_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for pairs whose errors touch every segment."""
    a, b, c = segments(fp)
    ra, ia = fuzzy(a)
    rb, ib = fuzzy(b)
    # every index of A with every index of B of the same row
    nb = np.bincount(rb, minlength=len(fp))
    first = np.concatenate([[0], np.cumsum(nb)[:-1]]) if len(fp) else nb
    times = nb[ra]
    left = np.repeat(np.arange(len(ra)), times)
    offset = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    row = ra[left]
    pair = ia[left] << 12 | ib[first[row] + offset]
    rows, keys = [], []
    for part in range(3):
        rows.append(row)
        keys.append((part << 30) | (pair << 6) | (c[row] >> (6 * part) & 63))
    return np.concatenate(rows), np.concatenate(keys)


KINDS = {"exact": exact_keys, "spread": spread_keys}


def keyed(nodes: DataFrame, kind: str) -> DataFrame:
    """(key, fp, comp): the keys of every node."""

    def keys(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at:at + 4096]
                fp, comp = part["fp"].to_numpy(), part["comp"].to_numpy()
                row, key = KINDS[kind](fp)
                yield pd.DataFrame({"key": key, "fp": fp[row], "comp": comp[row]})
        give_back()

    return nodes.mapInPandas(keys, "key long, fp long, comp long")


# ---- links ----------------------------------------------------------------------

def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits (bitwise_count of a signed value would count those of its absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


class Forest:
    """Union-find over the components that one task has linked."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def short_runs(key: np.ndarray, fp: np.ndarray, comp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked components in sorted rows whose runs are short: compares rows that are one, two, ... apart."""
    left = np.arange(len(key))
    for step in range(1, len(key)):
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            return
        other = left + step
        near = (distance(fp[left], fp[other]) <= bits) & (comp[left] != comp[other])
        yield comp[left[near]], comp[other[near]]


def long_run(fp: np.ndarray, comp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of one run: breadth first, comparing only with what is not reached yet."""
    rest = np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = distance(fp[rest], fp[x]) <= bits
            if near.any():
                hit, rest = rest[near], rest[~near]
                yield np.full(len(hit), comp[x]), comp[hit]
                queue.extend(hit)


def links(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b): linked components, from rows sorted by key inside their partition."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()

        def settle(key: np.ndarray, fp: np.ndarray, comp: np.ndarray) -> pd.DataFrame:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            ends = np.append(starts[1:], len(key))
            long = [(s, e) for s, e in zip(starts, ends) if e - s > 64] if len(key) and (ends - starts).max() > 64 else []
            short = np.ones(len(key), dtype=bool)
            found = []
            for s, e in long:
                short[s:e] = False
                found.extend(long_run(fp[s:e], comp[s:e], bits))
            found.extend(short_runs(key[short], fp[short], comp[short], bits))
            if not found:
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            fresh = [p for p in pairs.tolist() if forest.join(*p)]
            return pd.DataFrame(fresh, columns=["a", "b"], dtype="int64")

        held: list[tuple[np.ndarray, ...]] = []
        for pdf in batches:
            key, fp, comp = (pdf[c].to_numpy() for c in ("key", "fp", "comp"))
            if not len(key):
                continue
            if held and key[-1] == held[0][0][-1] == key[0]:
                held.append((key, fp, comp))
                continue
            last = int(np.searchsorted(key, key[-1]))
            done = [*held, (key[:last], fp[:last], comp[:last])]
            yield settle(*(np.concatenate(x) for x in zip(*done)))
            held = [(key[last:], fp[last:], comp[last:])]
        if held:
            yield settle(*(np.concatenate(x) for x in zip(*held)))
        give_back()

    return rows.mapInPandas(run, "a long, b long")


def linked(nodes: DataFrame, kind: str, opts: SimHash) -> DataFrame:
    """Distinct (a, b) links between components that share a key of this kind."""
    sample = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(HOT_SAMPLE)) == 0)
    hot = keyed(sample, kind).groupBy("key").count().where(F.col("count") * HOT_SAMPLE > opts.max_run)
    hot = materialize(hot.select(F.col("key").alias("hot_key"), F.ceil(F.col("count") * HOT_SAMPLE / opts.max_run)
                                 .cast("int").alias("chunks")), f"hot-keys-{kind}")
    rows = keyed(nodes, kind)
    if hot.isEmpty():
        dealt = rows.repartition("key").sortWithinPartitions("key")
    else:
        rows = rows.join(hot, F.col("key") == F.col("hot_key"), "left").drop("hot_key")
        chunks = F.coalesce("chunks", F.lit(1))
        own = F.pmod(F.xxhash64("fp", F.lit(1)), chunks).cast("int")
        block = F.explode(F.transform(F.sequence(F.lit(0), chunks - 1),
                                      lambda c: F.least(c, own) * 65536 + F.greatest(c, own)))
        # a block's rows form a run of their own: the block number is put into the key's free bits by hashing both
        rows = rows.select("key", "fp", "comp", "chunks", block.alias("block"))
        rows = rows.select(F.when(F.col("chunks").isNull(), F.col("key")).otherwise(F.xxhash64("key", "block")).alias("key"), "fp", "comp")
        dealt = rows.repartition("key").sortWithinPartitions("key")
    return links(dealt, opts.max_bits).distinct()


def grouped(docs: DataFrame, opts: SimHash = SimHash(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = materialize(with_fingerprints(docs, doc_id, text, opts.shingle), "fingerprints")
    comps = materialize(fingerprint_components(prints, opts), "simhash-components")
    return prints.join(comps, "fp").select("doc_id", "fp", "component_id")


def fingerprint_components(prints: DataFrame, opts: SimHash) -> DataFrame:
    """(fp, comp, component_id) for every distinct fingerprint of (doc_id, fp)."""
    labels = fingerprint_labels(prints, opts)
    # written, so that a component with very many fingerprints can be split in the join
    least = materialize(labels.groupBy("comp").agg(F.min("least").alias("component_id")), "simhash-least")
    return labels.join(least, "comp").select("fp", "comp", "component_id")


def fingerprint_labels(prints: DataFrame, opts: SimHash) -> DataFrame:
    """(fp, comp, least) for every distinct fingerprint of (doc_id, fp): its component and its own smallest doc_id."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    start = nodes.select("fp", F.col("fp").alias("comp"))
    first = materialize(components(linked(start, "exact", opts)), "simhash-exact")
    merged = materialize(relabel(start, first), "simhash-merged")
    second = materialize(components(linked(merged, "spread", opts)), "simhash-spread")
    return materialize(relabel(merged, second).join(nodes, "fp"), "simhash-labels")


def relabel(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with ``comp`` replaced by its label where it has one."""
    return nodes.join(labels, F.col("comp") == F.col("node"), "left").select(
        "fp", F.coalesce("label", "comp").alias("comp"))


def hex_fingerprint(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_of_each(docs: DataFrame, opts: SimHash = SimHash(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, all columns kept: the row with the
    least (doc_id, fingerprint, hash of id and text), a null doc_id last.  Rows
    that share a doc_id but not a component stay side by side; of rows equal in
    doc_id and text one stays."""
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    prints = materialize(with_fingerprints(docs, doc_id, text, opts.shingle, (k1.alias("k1"), k2.alias("k2"))), "fingerprints")
    comps = fingerprint_labels(prints, opts)
    # reduced by fingerprint first: many copies of one text are one row in the join
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "k1", "k2")).alias("row")
    chosen = prints.groupBy("fp").agg(least).join(comps.select("fp", "comp"), "fp")
    chosen = chosen.groupBy("comp").agg(F.min("row").alias("row"))
    keep = materialize(chosen.select(F.col("row.k1").alias("__kept_1"), F.col("row.k2").alias("__kept_2")), "simhash-kept")
    # joined and reduced by one key: the text is shuffled once
    d1, d2 = row_key(docs[doc_id], docs[text])
    own = docs.select("*", d1.alias("__k1"), d2.alias("__k2"))
    stay = own.join(keep, (F.col("__k1") == F.col("__kept_1")) & (F.col("__k2") == F.col("__kept_2")), "left_semi")
    return stay.dropDuplicates(["__k1", "__k2"]).select(*docs.columns)
