"""Token files with directly addressable codes (operator 2).

File format.  A shard file is a sequence of segments, each followed by one line
feed; a segment holds whole documents, in ascending doc_id order (nulls first).
Little-endian throughout::

    magic "DACT", u32 version, u64 length of the segment, u64 partition,
    u64 number in the partition, u64 documents D, u64 tokens N, u32 levels L,
    u32 bytes of the null bitmap
    D x i64 doc_id, null bitmap, (D + 1) x u64 first token of each document
    for each level: u64 codes C, C x u8 chunk, ceil(C / 8) bytes continuation
    bits, (ceil(C / 512) + 1) x u64 rank directory (continuation bits before
    each block of 512)

A token id is cut into 8-bit chunks, lowest first; level 0 has a chunk of every
token, level k + 1 those whose continuation bit is set at level k.  To read
token i: take its chunk, and while its continuation bit is set go on at
``rank(i)`` of the next level, where rank is one directory entry plus a count
of bits in one block.  No other token is decoded; ``Segment`` works on bytes, a
memory map, or any buffer.

Spark does the distribution: documents are range-partitioned by doc_id, sorted
inside the partition, tokenised and packed by ``mapInArrow``, and the packed
segments are written by Spark's own file writer (one file per partition, with
its commit protocol, on any store it can reach).  Reading uses the binaryFile
source.  Positions are running totals over one row per segment.

Tokenising: white space never is part of a token of this vocabulary and nothing
composes across a space, so a text's ids are the concatenated ids of its
space-separated pieces.  A batch's pieces are numbered, each distinct one is
encoded once by the library, and the ids are gathered by number.  Words of
Latin-1 letters, apart from the marks after them, go to the library's model
directly (a worker remembers up to about ``CACHE`` of them); any other piece
takes its full way through normaliser and pre-tokeniser.

Defined cases: null and empty texts have the end id only; rows with one doc_id
(nulls too) each keep their tokens, in the order of their text's hash; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.llm.common import materialize
from roadpulse.session import ensure_checkpoint_dir

MAGIC, VERSION = b"DACT", 1
HEADER = struct.Struct("<4sIQQQQQII")
BLOCK = 512
END_ID = 1
CACHE = 200_000
SEGMENT_TOKENS = 2_000_000
#: octets of text that are cut at once, and segments of a file (a reader holds a whole file)
TEXT_BYTES, FILE_SEGMENTS = 16 << 20, 32
#: documents that are cut into pieces together
ROWS = 4_000


# ---- format ---------------------------------------------------------------------

def pack_level(chunks: np.ndarray, more: np.ndarray) -> bytes:
    bits = np.packbits(more, bitorder="little")
    per_block = np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.int64)
    ranks = np.concatenate([[0], np.cumsum(per_block)]).astype("<u8")
    return struct.pack("<Q", len(chunks)) + chunks.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes()


def pack_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, partition: int, number: int) -> bytes:
    levels, rest = [], ids.astype(np.int64)
    while True:
        more = rest > 255
        levels.append(pack_level(rest & 255, more))
        rest = rest[more] >> 8
        if not len(rest):
            break
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=bool), bitorder="little").tobytes()
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()
    body = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + nulls + starts + b"".join(levels)
    head = HEADER.pack(MAGIC, VERSION, HEADER.size + len(body), partition, number, len(doc_ids), len(ids), len(levels), len(nulls))
    return head + body


class Segment:
    """Read access to one packed segment that starts at ``at`` of a buffer."""

    def __init__(self, buffer, at: int = 0) -> None:
        self.buffer = memoryview(buffer)
        magic, version, self.length, self.partition, self.number, self.n_docs, self.n_tokens, n_levels, n_null = HEADER.unpack_from(self.buffer, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        at += HEADER.size
        take = lambda kind, n: np.frombuffer(self.buffer, kind, n, at)
        self.doc_ids = take("<i8", self.n_docs)
        at += 8 * self.n_docs
        self.null_ids = np.unpackbits(take(np.uint8, n_null), bitorder="little")[:self.n_docs].astype(bool)
        at += n_null
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            at += 8
            chunks = take(np.uint8, n)
            at += n
            bits = take(np.uint8, -(-n // 8))
            at += -(-n // 8)
            ranks = take("<u8", -(-n // BLOCK) + 1)
            at += 8 * (-(-n // BLOCK) + 1)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """Token ``i`` alone: one chunk and one rank per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = int.from_bytes(bits[block * BLOCK // 8:(i >> 3) + 1].tobytes(), "little")
            i = int(ranks[block]) + (inside & ((1 << (i - block * BLOCK)) - 1)).bit_count()
            shift += 8
        return value

    def all_tokens(self) -> np.ndarray:
        """Every token, as u32."""
        out, where = np.zeros(self.n_tokens, dtype="<u4"), np.arange(self.n_tokens)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks.astype("<u4") << np.uint32(8 * k)
            where = where[np.unpackbits(bits, bitorder="little")[:len(chunks)].astype(bool)]
        return out


def segments(buffer) -> Iterator[Segment]:
    at = 0
    while at < len(buffer):
        yield (found := Segment(buffer, at))
        at += found.length + 1


# ---- tokenising -----------------------------------------------------------------

#: a word that needs no normalising but lower case (composed Latin-1 letters, one lower-case character each), and the
#: marks after it, which the vocabulary's pre-tokeniser cuts off as one run
PLAIN = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[.,;:?!]*)$"
#: how a byte-level vocabulary writes bytes that are not printable Latin-1 characters: 256 and up, in order
HIDDEN = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
#: words that the library's model gets as one input, a comma after each
TOGETHER = 50


class Encoder:
    """The library's ids of many texts; one per worker and tokeniser."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        #: the model alone, for words that are one pre-token already
        self.model = Tokenizer(self.full.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        #: only for vocabularies that lower-case, drop white space and have one id for the comma that parts the model's
        #: words; others take the full way for every text
        comma = self.model.encode(",", add_special_tokens=False).ids
        self.comma = comma[0] if comma else -1
        self.splits = len(comma) == 1 and self.full.encode(" A  b.\n", add_special_tokens=False).ids == [
            i for part in ("a", "b", ".") for i in self.full.encode(part, add_special_tokens=False).ids]
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> pa.LargeListArray:
        """The ids of each text, all the way through the library."""
        found = [e.ids for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        return lists([len(x) for x in found], np.fromiter((i for x in found for i in x), "<u4"))

    def words(self, words: list[str], cache: int) -> pa.LargeListArray:
        """The ids of lower-case Latin-1 words, by the model alone."""
        if len(self.known) > cache:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        inputs = [w if w.isascii() else w.encode().decode("latin-1").translate(HIDDEN) for w in fresh]
        groups = [inputs[at:at + TOGETHER] for at in range(0, len(inputs), TOGETHER)]
        for n, e in enumerate(self.model.encode_batch_fast([" , ".join([*g, ""]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            octets, commas = ids.tobytes(), (4 * np.flatnonzero(ids == self.comma)).tolist()
            own = fresh[n * TOGETHER:(n + 1) * TOGETHER]
            self.known.update(zip(own, [octets[a:b] for a, b in zip([0, *(c + 4 for c in commas)], commas)]))
        found = [self.known[w] for w in words]
        return lists([len(x) // 4 for x in found], np.frombuffer(b"".join(found), dtype="<u4"))

    def pieces(self, pieces: pa.Array, cache: int = CACHE) -> pa.LargeListArray:
        """The ids of pieces without white space: those of word and marks, or of the whole piece."""
        split = pc.extract_regex(pieces, PLAIN)
        plain = split.is_valid()
        word = pc.utf8_lower(pc.struct_field(split.filter(plain), "word")).dictionary_encode()
        marks = pc.struct_field(split.filter(plain), "marks").dictionary_encode()
        other = pieces.filter(pc.invert(plain))
        parts = [self.words(word.dictionary.to_pylist(), cache), self.whole(marks.dictionary.to_pylist()), self.whole(other.to_pylist())]
        # every piece is two parts: word and marks, or the whole piece and the marks "" (none)
        first, second = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        is_plain, n_words, n_marks = plain.to_numpy(zero_copy_only=False), len(parts[0]), len(parts[1])
        first[is_plain], second[is_plain] = word.indices.to_numpy(), marks.indices.to_numpy() + n_words
        first[~is_plain], second[~is_plain] = np.arange(len(other)) + n_words + n_marks, n_words + n_marks + len(other)
        none = lists([0], np.empty(0, "<u4"))
        laid = pa.concat_arrays([*parts, none]).take(pa.array(np.column_stack([first, second]).ravel()))
        return pa.LargeListArray.from_arrays(laid.offsets.take(pa.array(np.arange(0, 2 * len(pieces) + 1, 2))), laid.values)

    def texts(self, texts: pa.Array, cache: int = CACHE) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        if not self.splits:
            found = self.whole([t or "" for t in texts.to_pylist()])
            return np.diff(found.offsets.to_numpy()), found.values.to_numpy()
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        del cut
        ids = self.pieces(coded.dictionary, cache).take(coded.indices)
        return np.diff(ids.offsets.to_numpy()[first]), ids.values.to_numpy()


def portions(batch: pa.RecordBatch, rows_at_once: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows_at_once`` rows and ``TEXT_BYTES`` octets of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, min(int(np.searchsorted(ends, before + TEXT_BYTES, "right")) - at, rows_at_once))
        yield batch.slice(at, n)
        at += n


def lists(sizes: list[int], values: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])), pa.array(values, pa.uint32()))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---- Spark ----------------------------------------------------------------------

def write_files(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                end_id: int = END_ID, shards: int | None = None, rows_at_once: int = ROWS, cache: int = CACHE) -> None:
    """Tokenise ``docs`` into shard files under ``folder`` (overwritten).
    ``rows_at_once`` and ``cache`` trade a worker's memory for encoding words again."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            blob = pack_segment(ids, np.concatenate(counts), np.concatenate(parts), partition, number)
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["segment"])

        for batch in batches:
            for rows in portions(batch, rows_at_once):
                n, tokens = encoder(tokenizer).texts(rows.column("text"), cache)
                parts.append(np.insert(tokens, np.cumsum(n), end_id))
                counts.append(n + 1)
                ids.extend(rows.column("doc_id").to_pylist())
                if sum(map(len, parts)) >= SEGMENT_TOKENS:
                    yield segment()
                    ids, counts, parts, number = [], [], [], number + 1
        if ids:
            yield segment()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(shards, *key) if shards else rows.repartitionByRange(*key)
    packed = dealt.sortWithinPartitions(*key).mapInArrow(pack, "segment binary")
    packed.select(F.col("segment").cast("string")).write.mode("overwrite").option("maxRecordsPerFile", FILE_SEGMENTS).text(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(partition, number, place, doc_id, first, n_tokens, ids_crc32) of every document in the files."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for s in segments(content.as_buffer()):
                    octets = s.all_tokens().tobytes()
                    ends = s.starts[1:]
                    crc = [zlib.crc32(octets[4 * a:4 * b]) for a, b in zip(s.starts, ends)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(s.n_docs, s.partition), pa.int64()), pa.array(np.full(s.n_docs, s.number), pa.int64()),
                        pa.array(np.arange(s.n_docs), pa.int64()), pa.array(s.doc_ids, pa.int64(), mask=s.null_ids),
                        pa.array(s.starts[:-1], pa.int64()), pa.array(ends - s.starts[:-1], pa.int64()), pa.array(crc, pa.int64()),
                    ], ["partition", "number", "place", "doc_id", "first", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(unpack, "partition long, number long, place long, doc_id long, first long, n_tokens long, ids_crc32 long")


def with_starts(found: DataFrame) -> DataFrame:
    """``start``: tokens of all documents before, over all files.  The running
    total goes over one row per segment, within and then across partitions."""
    per_segment = found.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    per_partition = per_segment.groupBy("partition").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("partition").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    across = per_partition.select("partition", before.alias("across"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("partition").orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = per_segment.withColumn("inside", inside).join(across, "partition")
    offsets = offsets.select("partition", "number", (F.col("across") + F.col("inside")).alias("offset"))
    return found.join(materialize(offsets, "segment-offsets"), ["partition", "number"]).withColumn("start", F.col("first") + F.col("offset"))


def tokenised(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", folder: str | None = None,
              end_id: int = END_ID, shards: int | None = None, rows_at_once: int = ROWS,
              cache: int = CACHE) -> DataFrame:
    """Write the files and return (doc_id, start, n_tokens, ids_crc32), read back from them."""
    import uuid

    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/token-files-{uuid.uuid4().hex[:12]}"
    write_files(docs, folder, tokenizer, doc_id, text, end_id, shards, rows_at_once, cache)
    found = materialize(read_documents(spark, folder), "token-documents")
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")
