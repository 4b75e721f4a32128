"""Training-corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of ``documents``, and further columns of any name as they
are.  An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadpulse.llm import decontam, host_rules, mixing, simhash, token_files
from roadpulse.llm.common import table
from roadpulse.session import ensure_checkpoint_dir

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules.  A null or empty text has too few words and goes; a row without a source has no host
    whose verdict could reject it; repeated rows are judged alike."""
    return host_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints: the least doc_id (none last).  Rows equal in id and text are one; rows
    that share an id but not a component stay; texts without words have one fingerprint and leave one row."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item.  A row answers for itself alone, also without an id; null and empty texts hold
    nothing; an empty benchmark removes nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it.  Rows without a source are a source of their own, the last; rows without
    words have size 0 and follow their source's threshold; equal rows are taken alike."""
    return mixing.take(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token files.  Rows without an id come first, repeated rows by text; a
    null text is the end id alone."""
    # the workers of the stages before still hold memory, so this stage takes little
    return token_files.tokenised(docs, public_tokenizers.path(TOKENIZER), rows_at_once=500, cache=40_000)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
    ("token output", token_output),
]

#: XXH64 fingerprints and the tokeniser are beyond SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        path = f"{base}/stage-{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
