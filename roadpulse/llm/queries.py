"""Registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import (decontam, host_rules, html_text, lexical, licences, line_windows, mixing, prefix_trie, quality_model,
                           simhash, token_counts, token_files, warc)
from roadpulse.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judged(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.without_repeats(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of nested directories; a short document with a licence in it is the licence file of its project."""
    docs = table(spark, sf_dir, "documents")
    block = lambda n: F.concat(F.lit("d"), F.floor(F.col("doc_id") / n).cast("string"))
    project = F.concat_ws("/", "source", block(200))
    notice = (F.length("text") < 500) & F.col("text").rlike(r"(?i)\blicen[cs]e")
    path = F.when(notice, F.concat_ws("/", project, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string")))).otherwise(
        F.concat_ws("/", project, "lang", block(20), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return licences.scanned(docs.select("doc_id", path.alias("path"), "text"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_of(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_token_files, op3_html_text, op4_decontamination,
                                   op5_host_rules, op6_line_dedup, op7_token_counts, op8_mixing, op9_simhash, op10_licences, op11_lexical_search, op12_warc,
                                   op13_prefix_trie)}

_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_TERM = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"

#: CRC-32 of the decimal id, bit by bit
_CRC32 = ("xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))), "
          "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))")

#: 20 bits of a hexadecimal digest are four base32 characters
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((('0x' || substr(sha, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1]), '')"

ORACLE = {
    "op13_prefix_trie": rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS pos,
    md5(length(r) || ':' || r || x) AS tok, CAST(length(x) AS BIGINT) AS chars
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS anchor, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
seq AS (
  SELECT c.conv_id, t.pos AS d, tok, chars FROM c JOIN t ON t.conv_id = c.anchor AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(n.n, 0)) + t.pos - c.h, tok, chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN n ON n.conv_id = c.anchor),
lists AS (
  SELECT c.conv_id, coalesce(list(tok ORDER BY d) FILTER (WHERE tok IS NOT NULL), []) AS w, coalesce(list(chars ORDER BY d) FILTER (WHERE tok IS NOT NULL), []) AS ch
  FROM c LEFT JOIN seq ON seq.conv_id = c.conv_id GROUP BY c.conv_id),
pre AS (
  SELECT conv_id, d, list_slice(w, 1, d) AS p, CASE WHEN d > 0 THEN ch[d] ELSE 0 END AS chars, d = len(w) AS ended FROM lists, unnest(range(0, len(w) + 1)) AS r(d)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256 FROM pre GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.p = node.p),
sub AS (
  SELECT list_slice(p, 1, a) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM full_node, unnest(range(0, d + 1)) AS r(a) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN sub ON sub.p = f.p LEFT JOIN node up ON f.d > 0 AND up.p = list_slice(f.p, 1, f.d - 1)""",
    "op12_warc": rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
told AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last IS NULL OR page_id = last THEN NULL ELSE last END AS refers_to
FROM told""",
    "op11_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERM} AS w FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, nn),
items AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERM}) AS term FROM benchmark)),
m AS (SELECT rid, doc_id, CAST(10 + (90 * len(w) * nn) // l AS BIGINT) AS m FROM d, total WHERE len(w) > 0),
scored AS (
  SELECT i.item_id, m.rid, m.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
  FROM items i JOIN tf ON tf.term = i.term JOIN weight w ON w.term = i.term JOIN m ON m.rid = tf.rid GROUP BY i.item_id, m.rid, m.doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10""",
    # without masks: every diagonal on which enough single words agree is laid
    "op4_decontamination": rf"""
WITH d AS (SELECT DISTINCT doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_TERMS} AS w FROM benchmark),
dw AS (SELECT doc_id, w[i] AS word, i FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
bw AS (SELECT item_id, len(w) AS n, w[i] AS word, i FROM b, unnest(range(1, len(w) + 1)) AS r(i)),
hits AS (
  SELECT doc_id, item_id, dw.i - bw.i AS diagonal FROM dw JOIN bw ON dw.word = bw.word
  GROUP BY doc_id, item_id, dw.i - bw.i, n HAVING count(*) >= least(11, n)),
laid AS (
  SELECT h.doc_id, h.item_id, h.diagonal, len(b.w) AS n, j,
    CASE WHEN j + h.diagonal BETWEEN 1 AND len(d.w) AND d.w[j + h.diagonal] = b.w[j] THEN 1 ELSE 0 END AS same
  FROM hits h JOIN d ON d.doc_id IS NOT DISTINCT FROM h.doc_id JOIN b ON b.item_id IS NOT DISTINCT FROM h.item_id, unnest(range(1, len(b.w) + 1)) AS r(j)),
runs AS (
  SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win,
    sum(same) OVER (PARTITION BY doc_id, item_id, diagonal) AS aligned FROM laid),
best AS (SELECT doc_id, item_id, diagonal, max(n) AS n, max(win) AS win, max(aligned) AS aligned FROM runs GROUP BY doc_id, item_id, diagonal)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_item_words, CAST(max(win) AS BIGINT) AS window_matches, CAST(max(aligned) AS BIGINT) AS aligned_matches
FROM best WHERE CASE WHEN n >= 13 THEN win >= 11 ELSE aligned = n END GROUP BY doc_id, item_id""",
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, regexp_replace(string_split(text, chr(10))[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)),
solid AS (SELECT * FROM lines WHERE line <> ''),
threes AS (
  SELECT doc_id, pos, line AS l1, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(pos) OVER w AS pos2, lead(pos, 2) OVER w AS pos3
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS k FROM threes WHERE l3 IS NOT NULL),
gone AS (SELECT doc_id, list_distinct(flatten(list([pos, pos2, pos3]))) AS removed FROM ranked WHERE k > 1 GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN g.removed IS NULL THEN d.text
       ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.removed, i - 1)), chr(10)) END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.removed), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id""",
    "op5_host_rules": rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_SPLIT} AS w FROM documents),
places AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS win FROM base, unnest(range(1, len(w) - 3)) AS r(i) WHERE len(w) >= 5),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM places) WHERE n > 1),
cover AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS r(k) GROUP BY rid),
feats AS (
  SELECT b.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN cover c ON b.rid = c.rid),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM feats),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
sums AS (
  SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(f)::DOUBLE / sum(n) AS m, sum(n::DOUBLE * n) AS nn, sum(f::DOUBLE * f / n) AS ffn FROM hosts),
spread AS (
  SELECT m, CASE WHEN n - nn / n > 0 THEN (ffn - n * m * m - (k - 1) * m * (1 - m)) / (n - nn / n) ELSE 0 END AS v FROM sums),
prior AS (
  SELECT m, least(greatest(CASE WHEN v <= 0 THEN 1e6 ELSE m * (1 - m) / v - 1 END, 1), 1e6) AS s FROM spread),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM judged""",
    "op8_mixing": rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, CAST(len({_SPLIT}) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS hash FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM base GROUP BY source),
levels AS (
  SELECT 0 AS step, CAST(-1 AS DOUBLE) AS old, (SELECT 1.5 * sum(source_size) / sum(weight) FROM src) AS level
  UNION ALL
  SELECT step + 1, level, (SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (WHERE weight * l.level >= 2 * source_size), 0))
      / sum(weight) FILTER (WHERE weight * l.level < 2 * source_size) FROM src)
  FROM levels l WHERE old <> level AND step < 1000),
final AS (SELECT level FROM levels WHERE level IS NOT NULL ORDER BY step DESC LIMIT 1),
plan AS (
  SELECT source, source_size, CASE WHEN weight * level >= 2 * source_size THEN 2.0 * source_size ELSE weight * level END::DOUBLE AS target
  FROM src, final),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS base_copies FROM plan),
marks AS (
  SELECT b.*, p.source_size, p.target, p.base_copies, p.target - p.base_copies * p.source_size AS budget,
    sum(size) OVER (PARTITION BY b.source ORDER BY hash) AS upto, sum(size) OVER (PARTITION BY b.source, hash) AS edge
  FROM base b JOIN whole p ON b.source IS NOT DISTINCT FROM p.source),
cut AS (SELECT source, min(hash) AS hash FROM marks WHERE budget > 0 AND upto >= budget GROUP BY source),
border AS (
  SELECT DISTINCT c.source, c.hash, m.upto - m.budget < m.budget - (m.upto - m.edge) AS taken
  FROM cut c JOIN marks m ON m.source IS NOT DISTINCT FROM c.source AND m.hash = c.hash)
SELECT doc_id, size, m.source_size, m.target,
  CAST(size * (base_copies + CASE WHEN b.hash IS NULL THEN 0 WHEN m.hash < b.hash OR (m.hash = b.hash AND b.taken) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM marks m LEFT JOIN border b ON m.source IS NOT DISTINCT FROM b.source""",
}
