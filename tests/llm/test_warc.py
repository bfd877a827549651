"""WARC archives against Python's own gzip reader, cut into ranges of any size, with false magic bytes and archives within archives."""

import glob
import gzip
import hashlib
import io
import json
import zlib

import pytest
from pyspark.sql import functions as F

from tessaria.llm import warc

LONG = "<p>" + "text of a page " * 100 + "</p>"
PAGES = [
    (1, "http://a.example/1", LONG), (2, "http://a.example/2", LONG), (9, "http://a.example/9", LONG), (9, "http://a.example/0", LONG), (9, "http://a.example/9", LONG), (None, "http://a.example/n", LONG),
    (3, "http://b.example/", "short"), (4, None, "short"), (5, "x\r\ny", None), (6, "", ""), (7, "http://ü.example/ß?q=%0D", "ü漢字" * 900), (8, "u", "x" * 999), (10, "u", "x" * 999), (11, "v", "y" * 1000), (12, "v", "y" * 1000),
    (None, None, "z" * 2000), (None, None, "z" * 2000), (13, "w", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60), (2**62, "big", "".join(chr(97 + (k * k) % 26) for k in range(300000))), (-4, "neg", LONG + "\n"),
]
SCHEMA = "page_id long, url string, html string, record_type string, payload_digest string, digest string"


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "t", "d", "x") for r in rows], SCHEMA).repartition(3)


def want(rows=PAGES):
    out = []
    for i, u, h in rows:
        raw = (h or "").encode()
        same = [(j is not None, j or 0, v or "") for j, v, g in rows if (g or "").encode() == raw]
        own = len(raw) < 1000 or (i is not None, i or 0, u or "") == max(same)
        top = max(same)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if own else "revisit", None if own or not top[0] else top[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 26, 4096, 97])
def test_round_trip(spark, size):
    got = warc.archive(pages(spark), range_bytes=size).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == want()


def test_copies_by_shuffle_and_broadcast(spark):
    rows = PAGES + [(100 + k, f"u{k}", LONG) for k in range(300)]
    decide = lambda most: sorted(map(tuple, warc.plan(pages(spark, rows), broadcast_bytes=most).drop("payload").collect()), key=str)
    assert decide(8 << 20) == decide(-1)
    assert sum(r[1] == "response" and r[5] == len(LONG) for r in decide(-1)) == 1


def test_other_readers_read_the_files(spark, tmp_path):
    where = f"file://{tmp_path}/w"
    warc.write_archives(warc.plan(pages(spark)), where, "2024-05-01T00:00:00Z", file_bytes=300)
    listed = json.load(open(f"{tmp_path}/w/{warc.LIST}"))
    files = sorted(glob.glob(f"{tmp_path}/w/*.warc.gz"))
    assert [f.rsplit("/", 1)[1] for f in files] == [n for n, _ in listed] and len(files) > 3
    seen = []
    for f in files:
        text = gzip.open(f).read()  # all members, one after another
        at = 0
        while at < len(text):
            head = text[at : text.index(b"\r\n\r\n", at)]
            n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))[16:])
            assert text[at + len(head) + 4 + n :][:4] == b"\r\n\r\n" and b"WARC-Date: 2024-05-01T00:00:00Z" in head
            seen.append(head)
            at += len(head) + 4 + n + 4
    assert len(seen) == len(PAGES) + len(files) and seen[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    got = warc.read_archives(spark, where, 1000)
    assert got.count() == len(seen) and got.where("record_type = 'warcinfo'").count() == len(files)
    texts = {r["record_id"]: r["payload"] for r in got.where("payload is not null").collect()}
    assert texts["urn:page:7"].decode() == "ü漢字" * 900 and texts["urn:page:5"] == b""
    with pytest.raises(Exception, match="has archives"):
        warc.write_archives(warc.plan(pages(spark)), where, "2024-05-01T00:00:00Z")


def test_files_of_lost_attempts_count_for_nothing(spark, tmp_path):
    where = f"file://{tmp_path}/w"
    warc.write_archives(warc.plan(pages(spark)), where, "2024-05-01T00:00:00Z")
    before = warc.read_archives(spark, where).count()
    stray = glob.glob(f"{tmp_path}/w/*.warc.gz")[0]
    open(f"{tmp_path}/w/part-lost.warc.gz", "wb").write(open(stray, "rb").read()[:500])
    assert warc.read_archives(spark, where).count() == before


def stored(data):
    """A member that holds its bytes as they are."""
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def made(*payloads, pack=warc.member):
    return b"".join(pack(warc.record("response", f"urn:page:{k}", "d", size=len(p), payload=p)) for k, p in enumerate(payloads))


def in_ranges(raw, span, chunk=64):
    return [m for at in range(0, len(raw), span) for m in warc.Scanner(io.BytesIO(raw), chunk).records(at, min(len(raw), at + span))]


@pytest.mark.parametrize("span", [1, 2, 3, 50, 211, 10**6])
@pytest.mark.parametrize("chunk", [3, 64, 1 << 18])
def test_each_record_has_one_owner(span, chunk):
    false = warc.MAGIC + b"\x00" * 7 + warc.MAGIC + b"\x08" + gzip.compress(b"no record") + gzip.compress(b"WARC/1.1\r\nno header line\r\n\r\n")
    raw = made(false * 3, b"", b"plain " * 40, warc.MAGIC, pack=stored) + made(b"packed " * 99)
    got = in_ranges(raw, span, chunk)
    assert [m.block.partition(b"\r\n\r\n")[2] for m in got] == [false * 3, b"", b"plain " * 40, warc.MAGIC, b"packed " * 99]
    assert [m.start for m in got[1:]] == [m.end for m in got[:-1]] and got[-1].end == len(raw)


def test_archives_in_payloads(spark, tmp_path):
    inner = made(b"one", b"two " * 30)
    raw = made(b"before", inner, b"after", pack=stored)
    assert len(in_ranges(raw, 20)) == 5  # the inner records are found by ranges that begin among them
    open(f"{tmp_path}/x.warc.gz", "wb").write(raw)
    for span in (20, 60, 10**6):
        got = warc.outermost(warc.read_archives(spark, f"{tmp_path}/x.warc.gz", span)).orderBy("member_start").collect()
        assert [bytes(r["payload"]) for r in got] == [b"before", inner, b"after"]


def test_broken_files_are_told(spark, tmp_path):
    raw = made(b"some text " * 500, b"more", b"last")
    with pytest.raises(ValueError, match="ends within"):
        in_ranges(raw[:-9], 10**6)
    second = in_ranges(raw, 10**6)[1].start
    for at in (12, second + 12, len(raw) - 90):  # damage where a header is
        open(f"{tmp_path}/x.warc.gz", "wb").write(raw[:at] + bytes([raw[at] ^ 0xFF, raw[at + 1] ^ 0xFF]) + raw[at + 2 :])
        with pytest.raises(Exception, match="bytes without a record|is broken|shorter than"):
            warc.outermost(warc.read_archives(spark, f"{tmp_path}/x.warc.gz")).count()
    lying = warc.member(warc.record("response", "urn:page:1", "d", digest="00" * 20, size=4, payload=b"text"))
    with pytest.raises(ValueError, match="differs from its digest"):
        warc.fields(in_ranges(lying, 100)[0])


def test_nothing(spark):
    assert warc.archive(pages(spark).limit(0)).count() == 0
    assert in_ranges(b"", 10) == [] and in_ranges(b"not a gzip file " * 100, 10) == []


def test_headers():
    assert warc.header_of(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3") == {"warc-type": "resource", "content-length": "3"}
    for bad in (b"WARC/x\r\nWARC-Type: a\r\nContent-Length: 3", b"WARC/1.0\r\nWARC-Type: a", b"WARC/1.0\r\nWARC-Type: a\r\nContent-Length: x", b"WARC/1.0\r\nno colon", b"HTTP/1.1 200 OK"):
        assert warc.header_of(bad) is None
    assert warc.bare("sha1:" + "A" * 32) == "00" * 20 and warc.bare("md5:x") == "md5:x" and warc.bare(None) is None and warc.labelled("00" * 20) == "sha1:" + "A" * 32


def test_html_column_of_other_rows(spark):
    """Extra columns named as the operator's own don't matter."""
    assert warc.plan(pages(spark).withColumn("best", F.lit(1))).columns == [f.split()[0] for f in warc.WRITTEN.split(", ")]
