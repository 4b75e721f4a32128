import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadpulse.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
LIB = Tokenizer.from_file(PATH)


def brute(rows):
    out = []
    for doc_id, text in rows:
        n = len(LIB.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id or 0, len((text or "").encode()), n, n > 512))
    return sorted(out)


def test_query_matches_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op7_token_counts(spark, SF).collect())) == brute(docs)


def test_odd_rows(odd_docs, no_docs):
    found = token_counts.counted(odd_docs, PATH)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect())
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sum(r.doc_id is None for r in found.collect()) == 2
    assert token_counts.counted(no_docs, PATH).count() == 0


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    blocks = token_counts.blocks(docs, PATH, "doc_id", "text")
    assert blocks.count() >= 1
    whole = sorted(map(tuple, token_counts.counted(docs, PATH).collect()))
    assert sorted(map(tuple, token_counts.counted(docs.repartition(9), PATH).collect())) == whole


PARTS = [*"ab'st \n\t\r\x0b\x0c\x1c\x1d\x85\xa0\u2003\u3000", "1", "²", "é", "中", "😀", "'ll", "<|endoftext|>", "<|", "  ", "\u0301"]
ODD = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@given(ODD)
@settings(max_examples=400, deadline=None)
def test_pieces_of_pre_tokens_sum_to_the_library(text):
    found = token_counts.frequencies(text, token_counts._special(PATH))
    n = sum(f * int(token_counts.pieces([p], PATH)[0]) for p, f in found.items())
    assert n == len(LIB.encode(text, add_special_tokens=False).ids)
