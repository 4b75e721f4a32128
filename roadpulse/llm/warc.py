"""WARC archives: a writer of compressed records and a splittable reader.

Written archives are ``.warc.gz`` files with one gzip member per record: a
``response`` with its HTTP header and payload or, where the same payload
belongs to a record with a larger id, a ``revisit`` that has the header alone
and refers to that record.  Repeated payloads are found by their SHA-256 in an
aggregate that combines before its shuffle; its repeated keys only are joined
back, so a payload that a third of the pages share costs no large group.

The reader needs no index.  Files are cut into byte ranges, one task reads a
range: it looks for the gzip magic, takes a hit for a record only if the octets
from there on inflate to a WARC header, and owns the records that *start*
inside its range, reading past its end for the last one.  Every record is read
by one task whatever the ranges are.  A worker holds one block of the file and
one record.

A task writes to a name of its own attempt, and only files that successful
tasks report count as written; a task that is run again leaves no half file
among them.  Paths are opened by ``pyarrow.fs`` (file, hdfs, s3, gs).

Rows and columns: a null html is an empty payload; equal rows give equal
records; among equal payloads the rows at the largest id are responses, and
those without an id refer to it, or are responses if none has one; an empty
table gives an archive without records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm.common import give_back, materialize
from roadpulse.session import ensure_checkpoint_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES, READ_TASKS = 32 << 20, 50_000
BLOCK = 1 << 20
#: A WARC header of more octets than this is none.
HEADER_LIMIT = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

FIELDS = ("path string, offset long, length long, type string, record_id string, target_uri string, date string, refers_to string, "
          "payload_bytes long, payload_digest string, valid boolean, payload binary")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def digest(octets: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(octets).digest()).decode()


# ---- writer -----------------------------------------------------------------------

def record(kind: str, ident: str, block: bytes, more: dict[str, str | None], content_type: str, date: str, level: int) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{ident}>", "WARC-Date": date, "Content-Type": content_type,
              "WARC-Block-Digest": f"sha1:{digest(block)}"} | {k: v for k, v in more.items() if v is not None} | {"Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(head.encode()) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def one_line(text: str | None) -> str | None:
    """A field value: line breaks and control characters percent-encoded."""
    return None if text is None else re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", text)


def page_urn(page_id: int | None, payload_digest: str, otherwise: str = "") -> str:
    return f"urn:page:{otherwise if page_id is None else page_id}:{payload_digest}"


def repeats(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(key, response_id): payloads of several pages, with the largest id."""
    groups = pages.where(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response_id"))
    return materialize(groups.where((F.col("n") > 1) & F.col("response_id").isNotNull()).drop("n"), "payload-repeats")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = 0, date: str = DATE, level: int = 6) -> DataFrame:
    """Write ``pages`` as archives in ``folder``: (path, bytes, n_records) of each file.

    Of payloads of ``min_bytes`` or more that are equal, the one with the largest id is written whole."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    same = repeats(rows.select("page_id", "payload", "key"), min_bytes)
    told = rows.join(same, "key", "left").select("page_id", "url", "payload", "response_id")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder.rstrip('/')}/pages-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        fs, path = opened(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        n, size = 0, 0
        with fs.open_output_stream(path, compression=None) as out:
            info = record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", b"format: WARC File Format 1.1\r\n", {},
                          "application/warc-fields", date, level)
            out.write(info)
            size += len(info)
            for batch in batches:
                for ident, target, payload, response in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "response_id"))):
                    ident, payload, response = ident.as_py(), payload.as_py(), response.as_py()
                    sha = digest(payload)
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    again = response is not None and ident != response
                    more = {"WARC-Target-URI": one_line(target.as_py()), "WARC-Payload-Digest": f"sha1:{sha}"}
                    if again:
                        more |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{page_urn(response, sha)}>"}
                    gz = record("revisit" if again else "response", page_urn(ident, sha, f"none-{task.partitionId()}-{n}"),
                                block if again else block + payload, more, "application/http; msgtype=response", date, level)
                    out.write(gz)
                    size += len(gz)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "n_records"])
        give_back()

    return materialize(told.mapInArrow(write, "path string, bytes long, n_records long"), "warc-files")


# ---- reader -----------------------------------------------------------------------

class Window:
    """The block of a file that was read last."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.start, self.octets = file, 0, b""

    def load(self, offset: int) -> None:
        self.file.seek(offset)
        self.start, self.octets = offset, self.file.read(BLOCK)

    def left(self, offset: int) -> int:
        return self.start + len(self.octets) - offset if offset >= self.start else 0

    def at(self, offset: int, most: int) -> memoryview:
        """Up to ``most`` octets from ``offset`` on, empty at the file's end."""
        if self.left(offset) <= 0:
            self.load(offset)
        return memoryview(self.octets)[offset - self.start:][:most]


def find_magic(window: Window, start: int, end: int) -> int | None:
    """Offset of the first gzip magic that starts in [start, end)."""
    at = start
    while at < end:
        if window.left(at) < len(MAGIC):
            window.load(at)
        if window.left(at) < len(MAGIC):
            return None
        hit = window.octets.find(MAGIC, at - window.start)
        if hit >= 0:
            return window.start + hit if window.start + hit < end else None
        at = window.start + len(window.octets) - len(MAGIC) + 1
    return None


class Member:
    """One gzip member, inflated as it is asked for."""

    def __init__(self, window: Window, offset: int):
        self.window, self.at, self.gz = window, offset, zlib.decompressobj(31)

    def more(self) -> bytes:
        """The next octets; empty at the member's end.  Raises where the octets are no gzip member."""
        while not self.gz.eof:
            octets = self.gz.unconsumed_tail
            if not octets:
                octets = self.window.at(self.at, BLOCK // 16)
                self.at += len(octets)
                if not octets:
                    raise zlib.error("member is cut off")
            if found := self.gz.decompress(octets, BLOCK):
                return found
        return b""

    def end(self) -> int:
        """Offset after the member, once it is read."""
        return self.at - len(self.gz.unused_data)

    def header(self) -> tuple[dict[str, str], bytes] | None:
        """(WARC fields, what follows them so far), None if this is no WARC record."""
        got = b""
        try:
            while (cut := got.find(b"\r\n\r\n")) < 0:
                octets = self.more()
                got += octets
                if not octets or len(got) > HEADER_LIMIT or not (got.startswith(b"WARC/") or len(got) < 5):
                    return None
        except zlib.error:
            return None
        lines = got[:cut].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        sound = got.startswith(b"WARC/") and "warc-type" in fields and fields.get("content-length", "").isdigit()
        return (fields, got[cut + 4:]) if sound else None


def records_of(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes, bool]]:
    """(offset, length, fields, block, whole) of the records that start in [start, end)."""
    at: int | None = start
    window = Window(file)
    while (at := find_magic(window, at, end)) is not None:
        member = Member(window, at)
        head = member.header()
        if head is None:
            at += 1
            continue
        fields, first = head
        block = bytearray(first)
        want, whole = int(fields["content-length"]), True
        try:
            while octets := member.more():
                block += octets
            after = member.end()
        except zlib.error:
            whole, after = False, at + 1
        whole = whole and len(block) == want + 4 and block.endswith(b"\r\n\r\n")
        yield at, after - at, fields, bytes(block[:want]), whole
        at = after


def described(fields: dict[str, str], block: bytes, whole: bool) -> tuple[int | None, str | None, bool, bytes]:
    """(payload_bytes, payload_digest, valid, payload): digests in the header are compared with the octets."""
    http = fields.get("content-type", "").startswith("application/http")
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    valid = whole and fields.get("warc-block-digest", f"sha1:{digest(block)}") == f"sha1:{digest(block)}"
    if fields["warc-type"] == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return int(size[1]) if size else None, told, valid, b""
    found = digest(payload)
    return len(payload), found, valid and told in (None, found), payload


def splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, end) of every byte range, dealt one to a task (or evenly to ``READ_TASKS``, if there are more)."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    cut = files.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    cut = cut.select("path", "start", F.least("bytes", F.col("start") + split_bytes).alias("end"))
    return cut.repartition(min(max(1, cut.count()), READ_TASKS))


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """Every record of ``files`` (path, bytes): see ``FIELDS``.  ``payload`` is null unless asked for;
    ``valid`` is false where octets are missing or a digest differs; a revisit has the size and digest that it states."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[t])
                            for n, t in (f.split() for f in FIELDS.split(", "))])
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                fs, local = opened(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(local) as file:
                    for offset, length, fields, block, whole in records_of(file, start, end):
                        size, sha, valid, payload = described(fields, block, whole)
                        rows.append((path, offset, length, fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"),
                                     fields.get("warc-date"), fields.get("warc-refers-to"), size, sha, valid, payload if payloads else None))
                        held += len(payload) if payloads else 0
                        if len(rows) >= 10_000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
        give_back()

    return splits(files, split_bytes).mapInArrow(read, FIELDS)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives in a folder of any origin."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def page_of(urn: str) -> Column:
    """The page id in a record id; null if it has none."""
    return F.regexp_extract(urn, r"urn:page:(-?\d+):", 1).try_cast("long")


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` and return their records, read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/warc-{uuid.uuid4().hex[:12]}"
    found = read_archives(write_archives(pages, folder, min_bytes=min_bytes), split_bytes)
    return found.where(F.col("type") != "warcinfo").select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page_of("refers_to").alias("refers_to"))
