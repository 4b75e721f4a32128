"""Ranked lexical search by bag deduplication.

Every document is restricted to the vocabulary of the query items: its *bag* is
the sorted (term, tf) pairs of that vocabulary, and with the length class m it
is all that the score depends on.  Documents with the same bag and m form a
class; classes are found by a 64-bit hash and told apart by the bag itself, and
each class is scored once.  The best classes of an item are then expanded to
their members by ascending doc_id.

The score is integer arithmetic: with w = floor(1000 ln((2N+2) / (2df+1))) and
m = 10 + (90 n N) div L, a document scores the sum over the item's terms of
w * ((10^9 tf) div (1000 tf + 8 m)).

The items are a stated query set that meets all documents in blocks.  A block
holds at most ``BLOCK_POSTINGS`` (item, term) pairs (or one item), counted
before it is sent to the workers; more items mean more blocks, each a pass over
the documents.  The work of a pass is one Python scan of the texts, one shuffle
of bags (copies combine before it), and ten rows per item and task after it.

Rows and columns: items are told apart by item_id (rows that share one, null
included, are one item with the terms of all); a null text has no terms; every
row of the documents is a document, repeated rows too, and rows without doc_id
come last among equal scores.  Empty tables give no rows.  Other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.llm.common import give_back, materialize

BLOCK_POSTINGS = 200_000
#: Cells of a block of scores (classes x items), and (entry, item) pairs laid out at once.
CELLS, PAIRS = 1_000_000, 2_000_000
NO_ID = np.iinfo(np.int64).max

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: ASCII that is no letter or digit parts terms; A-Z become a-z; other octets belong to terms as they are.
_LAID = bytes(c if c >= 0x80 or c in _KEEP else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_LAID).split() if text else []


def octets(texts: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in texts.cast(pa.large_binary()))


# ---- items ------------------------------------------------------------------------

def postings(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct (item_id, term) pairs."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, words in zip(batch.column("item_id").to_pylist(), octets(batch.column("text"))):
                found = list(set(terms(words)))
                yield pa.RecordBatch.from_arrays([pa.array([ident] * len(found), pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(split, "item_id long, term binary").distinct()


def blocks(pairs: DataFrame, most: int = BLOCK_POSTINGS) -> tuple[Column, int]:
    """(block of a row, number of blocks): no block of more than ``most`` pairs, unless it is a single item."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64(F.col("item_id").isNull(), "item_id"), F.lit(n)).cast("int")
        sizes = pairs.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("a"), F.max("item_id").alias("b"),
                                                        F.count_if(F.col("item_id").isNull()).alias("none"))
        single = F.col("a").eqNullSafe(F.col("b")) & ((F.col("none") == 0) | (F.col("none") == F.col("n")))
        if sizes.where((F.col("n") > most) & ~single).isEmpty():
            return block, n
        n *= 2


class Block:
    """The items of one block: vocabulary, and for each term the numbers of its items."""

    def __init__(self, rows: pa.Table):
        words = rows.column("term").to_pylist()
        ids = rows.column("item_id").to_pylist()
        self.terms = sorted(set(words))
        self.number = {t: k for k, t in enumerate(self.terms)}
        self.items = sorted(set(ids), key=lambda x: (x is None, x))
        place = {x: k for k, x in enumerate(self.items)}
        term = np.array([self.number[t] for t in words], dtype=np.int64)
        order = np.argsort(term, kind="stable")
        self.members = np.array([place[x] for x in ids], dtype=np.int64)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.terms)))])


# ---- documents --------------------------------------------------------------------

def bags(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, bag): terms of the whole text with repeats, and the sorted (term, tf) pairs of the block's vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(block.number)

    def restrict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.get
        for batch in batches:
            n, found = [], []
            for text in octets(batch.column("text")):
                words = terms(text)
                n.append(len(words))
                tf = Counter(map(known, words))
                tf.pop(None, None)
                found.append(np.array(sorted(tf.items()), dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n", "bag"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(restrict, "doc_id long, n long, bag binary")


def pairs_of(bag: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of every pair of the bags."""
    sizes = pc.binary_length(bag).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    laid = np.frombuffer(b"".join(bag.to_pylist()), dtype="<i4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), laid[:, 0], laid[:, 1]


def class_key() -> list[Column]:
    return [F.xxhash64("m", "bag").alias("hash"), F.col("m"), F.col("bag")]


def classes_of(found: DataFrame) -> DataFrame:
    """(class_id, hash, m, bag, n_docs, first_id): the rows of ``found`` (m, bag) that are equal, by hash and by value."""
    groups = found.where(F.length("bag") > 0).groupBy(*class_key()).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_id"))
    return materialize(groups.withColumn("class_id", F.monotonically_increasing_id()), "bag-classes")


def document_frequencies(classes: DataFrame, n_terms: int) -> DataFrame:
    """(term, df): documents that hold the term."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            row, term, _ = pairs_of(batch.column("bag"))
            np.add.at(df, term, batch.column("n_docs").to_numpy()[row])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "n"])

    parts = classes.select("n_docs", "bag").mapInArrow(add, "term long, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("df"))


class Best:
    """The ``k`` best classes of each item, by (score, first member)."""

    def __init__(self, k: int):
        self.k = k
        self.rows = np.empty((0, 4), dtype=np.int64)  # item, -score, first_id, class_id

    def limits(self, n_items: int) -> np.ndarray:
        """Scores that a class must reach, as things stand."""
        least = np.ones(n_items, dtype=np.int64)
        last = self.place == self.k - 1 if len(self.rows) else np.empty(0, dtype=bool)
        least[self.rows[last, 0]] = -self.rows[last, 1]
        return least

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate([self.rows, rows])
        rows = rows[np.lexsort(rows.T[[3, 2, 1, 0]])]
        starts = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - starts
        self.rows, self.place = rows[place < self.k], place[place < self.k]


def best_classes(classes: DataFrame, block: Block, weights: np.ndarray, k: int) -> DataFrame:
    """(item_id, class_id, score, first_id): each task's k best classes of each item."""
    sent = classes.sparkSession.sparkContext.broadcast((block.items, block.members, block.first, weights))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, members, first, w = sent.value
        best, at_once = Best(k), max(1, CELLS // len(items))
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                row, term, tf = pairs_of(batch.column("bag"))
                m = batch.column("m").to_numpy()[row]
                value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                sums = np.zeros(batch.num_rows * len(items), dtype=np.int64)
                n = first[term + 1] - first[term]
                ends = np.cumsum(n)
                cuts = np.searchsorted(ends, np.arange(PAIRS, (ends[-1] if len(ends) else 0) + PAIRS, PAIRS))
                for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(n)]])):
                    if a < b:
                        reps = n[a:b]
                        inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                        item = members[np.repeat(first[term[a:b]], reps) + inside]
                        np.add.at(sums, np.repeat(row[a:b] * len(items), reps) + item, np.repeat(value[a:b], reps))
                sums = sums.reshape(batch.num_rows, len(items))
                r, i = np.nonzero(sums >= best.limits(len(items)))
                ids = batch.column("first_id").fill_null(NO_ID).to_numpy()
                best.add(np.column_stack([i, -sums[r, i], ids[r], batch.column("class_id").to_numpy()[r]]))
        i, minus, ids, cls = best.rows.T
        yield pa.RecordBatch.from_arrays([pa.array([items[x] for x in i], pa.int64()), pa.array(cls, pa.int64()), pa.array(-minus, pa.int64()),
                                          pa.array(ids, pa.int64(), mask=ids == NO_ID)], ["item_id", "class_id", "score", "first_id"])
        give_back()

    return classes.select("class_id", "m", "bag", "first_id").mapInArrow(score, "item_id long, class_id long, score long, first_id long")


def first_of(rows: DataFrame, by: str, order: list[Column], k: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text",
           doc_id: str = "doc_id", text: str = "text", most_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, scores above 0."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pairs = materialize(postings(items, item_id, item_text), "item-terms")
    block_of, n_blocks = blocks(pairs, most_postings)
    out = None
    for b in range(n_blocks):
        rows = pairs.where(block_of == b).toArrow()
        if rows.num_rows:
            part = _ranked(docs, Block(rows), k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def _ranked(docs: DataFrame, block: Block, k: int) -> DataFrame:
    found = materialize(bags(docs, block), "bags")
    n_docs, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # 38 digits: 90 n N passes 64 bits for long texts in a large corpus, m does not
    m = F.expr(f"10 + (CAST(90 AS DECIMAL(2)) * CAST(n AS DECIMAL(18)) * CAST({n_docs} AS DECIMAL(18))) div CAST({length} AS DECIMAL(38))")
    found = found.withColumn("m", m.cast("long"))
    classes = classes_of(found)
    df = document_frequencies(classes, len(block.terms))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    known = df.select("term", w.alias("w")).toArrow()
    weights = np.zeros(len(block.terms), dtype=np.int64)
    weights[known.column("term").to_numpy()] = known.column("w").to_numpy()

    order = [F.col("score").desc(), F.col("first_id").asc_nulls_last(), F.col("class_id").asc()]
    best = materialize(first_of(best_classes(classes, block, weights, k), "item_id", order, k, "place"), "best-classes")
    # members: rows of a wanted hash first, then only those whose bag and m are the class's own
    wanted = classes.join(best.select("class_id").distinct(), "class_id").select("class_id", "hash", "m", "bag")
    wanted = materialize(wanted, "wanted-classes")
    near = found.select("doc_id", *class_key()).join(wanted.select("hash").distinct(), "hash", "left_semi")
    members = near.join(wanted, ["hash", "m", "bag"]).select("class_id", "doc_id")
    members = first_of(members, "class_id", [F.col("doc_id").asc_nulls_last()], k, "nth").drop("nth")
    rows = best.select("item_id", "class_id", "score").join(members, "class_id")
    top = first_of(rows, "item_id", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k, "rank")
    return top.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
