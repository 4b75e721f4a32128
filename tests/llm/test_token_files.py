import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadpulse.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
LIB = Tokenizer.from_file(PATH)


def expected(rows):
    """Library ids of whole texts, in order."""
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_matches_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = [tuple(r) for r in queries.op2_token_files(spark, SF).orderBy("doc_id").collect()]
    assert got == expected(docs)


def test_several_shards_and_small_cuts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = token_files.tokenised(docs, PATH, shards=7, rows_at_once=3, cache=50).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == expected(docs.orderBy("doc_id").collect())


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = token_files.tokenised(odd_docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in found) == sorted((d or 0, n, c) for d, _, n, c in expected(rows))
    ends = sorted((r.start, r.start + r.n_tokens) for r in found)
    assert [a for a, _ in ends] == [0] + [b for _, b in ends[:-1]]
    assert [r.doc_id or 0 for r in sorted(found, key=lambda r: r.start)] == sorted(d or 0 for d, _ in rows)
    assert token_files.tokenised(no_docs, PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_any_token_without_decoding_others(n):
    rng = random.Random(n)
    ids = np.array([rng.choice([rng.randrange(200), rng.randrange(60_000), rng.randrange(1 << 30)]) for _ in range(n)], dtype=np.int64)
    blob = token_files.pack_segment([3, None], np.array([n // 2, n - n // 2]), ids, 5, 6)
    s = token_files.Segment(b"xx" + blob, 2)
    assert s.length == len(blob) and (s.partition, s.number) == (5, 6)
    assert s.all_tokens().tolist() == ids.tolist()
    assert [s.token(i) for i in range(n)] == ids.tolist()
    assert s.null_ids.tolist() == [False, True] and s.starts.tolist() == [0, n // 2, n]
    with pytest.raises(IndexError):
        s.token(n)


def test_segments_follow_each_other():
    blobs = [token_files.pack_segment([k], np.array([k]), np.arange(k) * 300, 0, k) for k in range(4)]
    found = list(token_files.segments(b"\n".join(blobs) + b"\n"))
    assert [s.n_tokens for s in found] == [0, 1, 2, 3]


PARTS = [*"ab'stAZ \n\t\r\x0b\x0c\x1c\x85\xa0 ", "1", "Σ", "İ", "é", "é", "́", "中", "'ll", "'LL", "<|endoftext|>", "  ", "ﬁ", "Word", "über.", "ÀÉÿ!?", "ß×÷", "µª"]


@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_pieces_join_to_the_library_ids(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    n, ids = token_files.encoder(PATH).texts(pa.array([None, text, "", text]))
    assert n.tolist() == [0, len(want), 0, len(want)] and ids.tolist() == want * 2
