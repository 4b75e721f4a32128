"""Token counts without token ids (operator 7).

A byte-level BPE tokeniser first cuts a text into pre-tokens; how many pieces a
pre-token becomes depends on nothing else.  So:

1. each document's pre-token frequencies are counted.  They are written in
   blocks: a block has the pre-tokens of some documents once, and per document
   their numbers and frequencies (packed integers);
2. the blocks' pre-tokens are shuffled by pre-token and sorted, and the pieces of
   each distinct one are counted once;
3. the counts return to their blocks (joined by block) and each document's
   frequencies are multiplied and summed.

What is shuffled is a row per block and distinct pre-token, not per occurrence
or per document.  A block ends after ``BLOCK_TOKENS`` distinct pre-tokens or
``BLOCK_PAIRS`` document entries, so memory does not depend on the input; a
pre-token that all blocks share has one row in each.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings
inside texts count as one token, the library's default; null doc_ids and
repeated rows are counted each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import materialize

#: fixed value: the byte-level vocabulary's pre-token pattern
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                        r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
BLOCK_TOKENS = 600_000
BLOCK_PAIRS = 2_000_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _special(path: str):
    """Pattern of the strings that the library takes out of a text before it is cut, longest first."""
    added = sorted((a.content for a in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, added))) if added else None


def frequencies(text: str, special) -> Counter:
    found: Counter = Counter()
    at = 0
    for m in special.finditer(text) if special else ():
        found.update(PATTERN.findall(text[at:m.start()]))
        found[m.group()] += 1
        at = m.end()
    found.update(PATTERN.findall(text[at:] if at else text))
    return found


def pieces(pre_tokens: list[str], path: str) -> np.ndarray:
    """How many tokens the library makes of each pre-token."""
    t = _tokenizer(path)
    return np.array([len(e) for e in t.encode_batch_fast(pre_tokens, add_special_tokens=False)], dtype=np.int64)


def _packed(values: np.ndarray) -> bytes:
    """u32 numbers, byte plane after byte plane (high planes are nearly empty), deflated."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("nameless", pa.list_(pa.bool_())), ("n_bytes", pa.list_(pa.int64())),
                    ("entries", pa.binary()), ("numbers", pa.binary()), ("freqs", pa.binary()), ("tokens", pa.list_(pa.string()))])
BLOCKS_DDL = "block long, doc_ids array<long>, nameless array<boolean>, n_bytes array<long>, entries binary, numbers binary, freqs binary, tokens array<string>"


def blocks(docs: DataFrame, tokenizer: str, doc_id: str, text: str) -> DataFrame:
    """Step 1: one row per block."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, number = _special(tokenizer), 0
        ids, sizes, entries, numbers, freqs, known, pairs = [], [], [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            at = (TaskContext.get().partitionId() << 32) + number
            row = [[at], [[d or 0 for d in ids]], [[d is None for d in ids]], [sizes], [_packed(np.array(entries))], [_packed(np.concatenate(numbers))], [_packed(np.concatenate(freqs))], [list(known)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, BLOCKS)], schema=BLOCKS)

        for batch in batches:
            for d, t in zip(batch.column("doc_id"), batch.column("text")):
                t = t.as_py() or ""
                found = frequencies(t, special)
                n = len(found)
                own = np.fromiter((known.setdefault(p, len(known)) for p in found), np.int64, n)
                order = np.argsort(own)  # pre-tokens that are new in a document have consecutive numbers
                numbers.append(np.diff(own[order], prepend=0))
                freqs.append(np.fromiter(found.values(), np.int64, n)[order])
                ids.append(d.as_py())
                sizes.append(len(t.encode()))
                entries.append(n)
                pairs += n
                if len(known) >= BLOCK_TOKENS or pairs >= BLOCK_PAIRS:
                    yield block()
                    number += 1
                    ids, sizes, entries, numbers, freqs, known, pairs = [], [], [], [], [], {}, 0
        if ids:
            yield block()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, BLOCKS_DDL)


def piece_counts(found: DataFrame, tokenizer: str) -> DataFrame:
    """Step 2: (block, numbers, n_pieces), packed; equal pre-tokens are neighbours and counted once."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_n, held, rows = None, 0, [], 0

        def by_block() -> pd.DataFrame:
            block, number, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((number, block))
            names, first = np.unique(block[order], return_index=True)
            parts = [order[a:b] for a, b in zip(first, [*first[1:], len(order)])]
            return pd.DataFrame({"block": names, "numbers": [_packed(np.diff(number[p], prepend=0)) for p in parts],
                                 "n_pieces": [_packed(n[p]) for p in parts]})

        for pdf in batches:
            codes, names = pd.factorize(pdf["token"])
            n = np.zeros(len(names), dtype=np.int64)
            known = int(len(names) > 0 and names[0] == last)
            if known:
                n[0] = last_n
            if len(names) > known:
                n[known:] = pieces(list(names[known:]), tokenizer)
            if len(names):
                last, last_n = names[-1], n[-1]
                held.append((pdf["block"].to_numpy(), pdf["number"].to_numpy(), n[codes]))
                rows += len(codes)
            if rows >= BLOCK_PAIRS:
                yield by_block()
                held, rows = [], 0
        if held:
            yield by_block()

    rows = found.select("block", F.posexplode("tokens").alias("number", "token"))
    return rows.repartition("token").sortWithinPartitions("token").mapInPandas(count, "block long, numbers binary, n_pieces binary")


def _totals(key: tuple, block: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    if not len(block):
        return pd.DataFrame({"doc_id": [], "n_bytes": [], "n_tokens": []})
    row = block.iloc[0]
    numbers = np.concatenate([np.cumsum(_unpacked(x)) for x in counts["numbers"]] or [np.zeros(0, np.int64)])
    n_pieces = np.zeros(len(numbers), dtype=np.int64)
    n_pieces[numbers] = np.concatenate([_unpacked(x) for x in counts["n_pieces"]] or [np.zeros(0, np.int64)])
    entries = _unpacked(row["entries"])
    ends = np.cumsum(entries)
    steps = np.concatenate([[0], np.cumsum(_unpacked(row["numbers"]))])  # numbers are differences within a document
    own = steps[1:] - np.repeat(steps[ends - entries], entries)
    each = n_pieces[own] * _unpacked(row["freqs"])
    upto = np.concatenate([[0], np.cumsum(each)])
    ids = pd.arrays.IntegerArray(np.array(row["doc_ids"], dtype=np.int64), np.array(row["nameless"], dtype=bool))
    return pd.DataFrame({"doc_id": ids, "n_bytes": np.asarray(row["n_bytes"], dtype=np.int64), "n_tokens": upto[ends] - upto[ends - entries]})


def counted(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    found = materialize(blocks(docs, tokenizer, doc_id, text), "pre-token-blocks")
    counts = piece_counts(found, tokenizer)
    totals = (found.drop("tokens").groupBy("block").cogroup(counts.groupBy("block"))
              .applyInPandas(_totals, "doc_id long, n_bytes long, n_tokens long"))
    return totals.withColumn("over_limit", F.col("n_tokens") > limit)
