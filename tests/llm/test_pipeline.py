"""The pipeline against the operators' SQL, brute-force fingerprints and the tokenizers library."""
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from roadpulse.llm import queries
from .conftest import DOCS
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def sql(docs, name):
    con = duckdb.connect()
    con.register("documents", docs)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    return con.execute(queries.ORACLE[name]).df()


def brute_force(docs):
    """(doc_id, start, n_tokens, ids_crc32) of the pipeline's rows."""
    judged = sql(docs, "op5_host_rules")
    docs = docs[docs.doc_id.isin(judged[judged.kept].doc_id)]
    sizes = [len(docs)]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.itertuples()}
    least = plain_components(list(prints.items()))
    docs = docs[[least[prints[d]] == d for d in docs.doc_id]]
    sizes.append(len(docs))
    docs = docs[~docs.doc_id.isin(sql(docs, "op4_decontamination").doc_id)]
    sizes.append(len(docs))
    mix = sql(docs, "op8_mixing").set_index("doc_id")
    lib, start, rows = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in docs.sort_values("doc_id").itertuples():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [1]
        for _ in range(int(mix.taken[r.doc_id] // mix["size"][r.doc_id])):
            rows.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
    return rows, sizes


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    want, sizes = brute_force(docs)
    assert len(docs) > sizes[0] > sizes[1] > sizes[2] > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def held_in(folder, docs, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(spark, odd_docs, tmp_path):
    """Nulls in every column, repeated rows, very long texts and clashing column names: good rows come out, once each group."""
    good = " ".join(f"word{i % 97}and{i}" for i in range(60))
    more = [(100 + i, f"{good} {i * 7919}" + " tail" * (i % 3), "en", None if i % 2 else "b", None) for i in range(12)] + [
        (None, good + " nameless", None, None, None), (None, "other " + good[::-1], "de", "a", 3), (200, good + " nameless", "en", "a", 2),
        (300, "benchmark passage one two three four five six seven eight nine ten eleven twelve thirteen " + good, "en", "a", 1)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, DOCS),
                                allowMissingColumns=True)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (None, None)], "item_id long, text string")
    sf = held_in(tmp_path, docs, bench)
    seen = []
    stage_docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, stage_docs, sf)
        assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(f"{tmp_path}/stage-{n}")
        stage_docs = spark.read.parquet(f"{tmp_path}/stage-{n}")
        seen.append([r.doc_id for r in stage_docs.collect()])
    assert 300 in seen[1] and 300 not in seen[2]
    assert 4 in seen[0] and 3 not in seen[0] and 2 not in seen[0]  # the long text passes, null and empty ones do not
    tokens = corpus_pipeline.STAGES[-1][1](spark, stage_docs, sf).collect()
    assert len(tokens) == len(seen[3]) > 0 and sorted(t.doc_id or 0 for t in tokens) == sorted(d or 0 for d in seen[3])
    ends = sorted((t.start, t.start + t.n_tokens) for t in tokens)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_pipeline_on_empty_tables(spark, no_docs, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert corpus_pipeline.run(spark, held_in(tmp_path, no_docs, bench)).collect() == []
