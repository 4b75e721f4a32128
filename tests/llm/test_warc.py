"""WARC writer and splittable reader: every record once, whatever the byte ranges."""
import base64
import gzip
import hashlib
import os
import random

import pytest

from roadpulse.llm import warc

SCHEMA = "page_id long, url string, html string"
ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "<p>ä" + "x" * 3000), (4, "u 4\r\nWARC-Type: x", ""), (5, "u5", None),
        (6, "u6", ""), (None, "u7", "<p>same</p>"), (None, None, "alone"), (None, "u", "alone"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "v", "other"),
        (8, "same row", "twice"), (8, "same row", "twice")]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        last = max(ids) if ids and len(data) >= min_bytes else page
        out.append((page, len(data), sha(html), "response" if page == last else "revisit", None if page == last else last))
    return sorted(out, key=str)


@pytest.mark.parametrize("split_bytes,min_bytes", [(1 << 20, 0), (97, 0), (1, 5)])
def test_round_trip(spark, split_bytes, min_bytes):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' AS key", "1 AS response_id", "'y' AS payload", "2 AS path").repartition(2)
    if split_bytes == 1:
        pages = pages.where("page_id < 4")
    got = warc.round_trip(pages, split_bytes=split_bytes, min_bytes=min_bytes)
    rows = [r for r in ROWS if split_bytes > 1 or (r[0] is not None and r[0] < 4)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, min_bytes)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def write(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def plain(n, body, kind="response"):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:n:{n}>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_foreign_archives_false_magic_and_broken_members(spark, tmp_path):
    """Archives of another writer, with the magic inside stored payloads, gzip members that are no records, and a cut-off end."""
    rnd = random.Random(2)
    bodies = [bytes(rnd.randrange(256) for _ in range(rnd.choice((10, 4000)))) + warc.MAGIC + b"\x00" * 7 + warc.MAGIC for _ in range(40)]
    members = [gzip.compress(plain(n, b), 0 if n % 2 else 6) for n, b in enumerate(bodies)]
    folder = str(tmp_path)
    write(folder, "a.warc.gz", gzip.compress(b"no record") + b"".join(members[:25]) + b"junk" + warc.MAGIC + b"junk" + b"".join(members[25:]))
    write(folder, "cut.warc.gz", members[0] + members[2][:-9])
    files = warc.archives_in(spark, folder)
    for split_bytes in (500, 1 << 25):
        got = warc.read_archives(files, split_bytes, payloads=True).collect()
        whole = sorted((r.record_id, bytes(r.payload), r.payload_bytes, r.payload_digest) for r in got if r.path.endswith("/a.warc.gz"))
        assert whole == sorted((f"<urn:n:{n}>", b, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for n, b in enumerate(bodies))
        assert all(r.valid for r in got if r.path.endswith("/a.warc.gz"))
        assert sorted((r.record_id, r.valid) for r in got if r.path.endswith("/cut.warc.gz")) == [("<urn:n:0>", True), ("<urn:n:2>", False)]


def test_changed_payload_is_invalid(spark, tmp_path):
    files = warc.write_archives(spark.createDataFrame([(1, "u", "some text")], SCHEMA).coalesce(1), str(tmp_path))
    path = files.first()["path"]
    data = open(path, "rb").read()
    second = data.index(warc.MAGIC, 3)
    changed = gzip.decompress(data[second:]).replace(b"some text", b"some tExt")
    write(str(tmp_path / "changed"), "x.warc.gz", data[:second] + gzip.compress(changed))
    got = {r.type: r.valid for r in warc.read_archives(warc.archives_in(spark, str(tmp_path / "changed"))).collect()}
    assert got == {"warcinfo": True, "response": False}
