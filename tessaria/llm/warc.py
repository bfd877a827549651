"""WARC archives as a data source: a writer of one gzip member per record, and a splittable reader.

A reading task gets a byte range of a file, seeks the magic bytes of a gzip
member in it, and takes a candidate for a record only if it decodes to a WARC
header; it owns the records that start inside its range, and reads on beyond
its end to finish the last one. Files are opened through ``pyarrow.fs``, so
that a path may be in any store that knows (file, hdfs, s3, gs). A write task
writes files of its own under names never used before, and the driver commits
them by one list of names, so that attempts that were lost or repeated count for nothing.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

from tessaria.llm.common import join_spread, keep, shared_dir, small_batches

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are stored again rather than revisited.
LEAST_BYTES = 1000
#: Bytes of a range that one task reads; bytes that are read at once; bytes at which a writer begins another file.
RANGE_BYTES, CHUNK, FILE_BYTES = 64 << 20, 1 << 18, 1 << 30
#: Bytes that are decompressed at once.
PIECE = 1 << 16
#: A header block of a record is no longer than this.
HEADER_BYTES = 1 << 20
#: The list of a folder's committed files.
LIST = "_files.json"

WRITTEN = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
READ = f"{WRITTEN}, record_date string, file string, file_bytes long, member_start long, member_end long"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    where = re.sub(r"^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", where)) if "://" in where or where.startswith("file:/") else (pafs.LocalFileSystem(), where)


def labelled(digest: str | None) -> str | None:
    """A SHA-1 in hex as archives write it, in base 32 after its name."""
    return None if digest is None else "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def bare(digest: str | None) -> str | None:
    """The hex form of a SHA-1 that an archive names, in base 32 or hex; another digest stays as it is."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() == "sha1" and len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower() if kind.lower() == "sha1" and len(value) == 40 else digest


def _line(name: str, value: str | None) -> str:
    """A header line, without line ends in its value; a null value has no line."""
    return "" if value is None else f"{name}: " + value.replace("\r", "%0D").replace("\n", "%0A") + "\r\n"


def record(kind: str, record_id: str | None, date: str, target: str | None = None, refers_to: str | None = None, digest: str | None = None, size: int = 0, payload: bytes = b"") -> bytes:
    """One record: a response or, without a payload of its own, a revisit, each with the HTTP header of the full payload."""
    if kind == "warcinfo":
        block, content = b"software: tessaria\r\nformat: WARC File Format 1.1\r\n", "application/warc-fields"
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if kind == "response" else b"")
        content = "application/http; msgtype=response"
    head = "WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", None if record_id is None else f"<{record_id}>") + _line("WARC-Date", date) + _line("WARC-Target-URI", target)
    head += _line("WARC-Payload-Digest", labelled(digest)) + _line("WARC-Refers-To", None if refers_to is None else f"<{refers_to}>") + _line("WARC-Profile", PROFILE if kind == "revisit" else None)
    return head.encode("utf-8", "surrogatepass") + f"Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def header_of(text: bytes) -> dict[str, str] | None:
    """The named fields (lower case) of a WARC header, or None if this is none."""
    first, _, rest = text.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", first):
        return None
    out: dict[str, str] = {}
    for line in rest.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            return None
        out[name.decode().lower()] = value.decode("utf-8", "surrogatepass").strip(" \t")
    return out if out.get("content-length", "").isdigit() and "warc-type" in out else None


@dataclass
class Member:
    start: int
    end: int
    header: dict[str, str]
    block: bytes


class Scanner:
    """Finds the records that start in a byte range of a file (an object with ``seek`` and ``read``), through one buffer."""

    def __init__(self, source, chunk: int = CHUNK):
        self.source, self.chunk, self.at, self.data = source, max(chunk, len(MAGIC)), 0, b""

    def _fill(self, at: int, least: int) -> bytes:
        """The buffer, which has ``least`` bytes from ``at`` on unless the file ends before."""
        if not self.at <= at <= self.at + len(self.data) - least:
            self.source.seek(at)
            self.at, self.data = at, self.source.read(self.chunk)
        return self.data

    def candidates(self, start: int, end: int) -> Iterator[int]:
        """Offsets of the magic bytes in [start, end); their later bytes may lie beyond it."""
        at = start
        while at < end:
            k = self._fill(at, len(MAGIC)).find(MAGIC, at - self.at, end - self.at + len(MAGIC) - 1)
            if k >= 0:
                at = self.at + k
                yield at
                at += 1
            elif len(self.data) < self.chunk:
                return  # the file's last bytes
            else:
                at = max(at + 1, self.at + len(self.data) - len(MAGIC) + 1)

    def decode(self, start: int) -> Member | None:
        """The record whose member starts here, or None where no WARC header is; a member that breaks after its header is an error."""
        z, at, text, head, cut = zlib.decompressobj(31), start, bytearray(), None, 0
        while not z.eof:
            data = memoryview(self._fill(at, 1))[at - self.at :][:PIECE]
            if not data:
                if head is None:
                    return None
                raise ValueError(f"the file ends within the record at byte {start}")
            at += len(data)
            while data and not z.eof:
                try:
                    text += z.decompress(data, PIECE if head is None else 0)
                except zlib.error:
                    if head is None:
                        return None
                    raise ValueError(f"the record at byte {start} is broken") from None
                data = z.unconsumed_tail
                if head is None:
                    if not b"WARC/".startswith(bytes(text[:5])):
                        return None
                    cut = text.find(b"\r\n\r\n")
                    head = header_of(bytes(text[:cut])) if cut >= 0 else None
                    if head is None and (cut >= 0 or len(text) > HEADER_BYTES):
                        return None
        if head is None:
            return None
        size = int(head["content-length"])
        if len(text) < cut + 4 + size:
            raise ValueError(f"the record at byte {start} is shorter than it says")
        return Member(start, at - len(z.unused_data), head, bytes(text[cut + 4 : cut + 4 + size]))

    def records(self, start: int, end: int) -> Iterator[Member]:
        """The records that start in [start, end). Where a record ends, the search goes on."""
        while start < end:
            found = next((m for at in self.candidates(start, end) if (m := self.decode(at)) is not None), None)
            if found is None:
                return
            yield found
            start = found.end


def fields(m: Member) -> dict:
    """A record's columns; a response's payload is checked against its digest, and a revisit has the size of the full payload."""
    h = m.header
    strip = lambda v: None if v is None else v[1:-1] if v[:1] == "<" and v[-1:] == ">" else v
    out = {
        "record_id": strip(h.get("warc-record-id")), "record_type": h["warc-type"], "target_uri": h.get("warc-target-uri"), "refers_to": strip(h.get("warc-refers-to")),
        "payload_digest": bare(h.get("warc-payload-digest")), "payload_bytes": None, "payload": None, "record_date": h.get("warc-date"), "member_start": m.start, "member_end": m.end,
    }
    if h.get("content-type", "").startswith("application/http"):
        head, _, body = m.block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        if h["warc-type"] == "revisit":
            out["payload_bytes"] = int(said[1]) if said else None
        else:
            out |= {"payload_bytes": len(body), "payload": body}
    elif h["warc-type"] != "warcinfo":
        out |= {"payload_bytes": len(m.block), "payload": m.block}
    if out["payload"] is not None:
        own = hashlib.sha1(out["payload"]).hexdigest()
        if re.fullmatch(r"[0-9a-f]{40}", out["payload_digest"] or own) and (out["payload_digest"] or own) != own:
            raise ValueError(f"the payload of the record at byte {m.start} differs from its digest")
        out["payload_digest"] = out["payload_digest"] or own
    return out


@dataclass
class Files(WriterCommitMessage):
    files: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.date, self.level, self.most = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z"), int(options.get("level", 6)), int(options.get("filebytes", FILE_BYTES))
        if not overwrite:
            store, where = open_store(self.path)
            if store.get_file_info(f"{where}/{LIST}").type != pafs.FileType.NotFound:
                raise FileExistsError(f"{self.path} has archives; name another folder, or overwrite")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, where = open_store(self.path)
        store.create_dir(where, recursive=True)
        done, out, name, size = [], None, "", 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{where}/{name}", compression=None)
                    size += out.write(member(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", self.date)))
                payload = r["payload"] or b""
                size += out.write(member(record(r["record_type"], r["record_id"], self.date, r["target_uri"], r["refers_to"], r["payload_digest"], r["payload_bytes"], payload), self.level))
                if size >= self.most:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        return Files(done)

    def commit(self, messages: list) -> None:
        """The files of the attempts that succeeded become the folder's content in one step."""
        store, where = open_store(self.path)
        store.create_dir(where, recursive=True)
        made = f"{where}/{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(made, compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())
        store.move(made, f"{where}/{LIST}")

    def abort(self, messages: list) -> None:
        store, where = open_store(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            store.delete_file(f"{where}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.span, self.payload = options["path"].rstrip("/"), int(options.get("rangebytes", RANGE_BYTES)), options.get("payload", "true").lower() == "true"
        self.chunk = int(options.get("chunkbytes", CHUNK))

    def partitions(self) -> list[Range]:
        store, where = open_store(self.path)
        if store.get_file_info(where).type == pafs.FileType.File:
            files = [(self.path, store.get_file_info(where).size)]
        elif store.get_file_info(f"{where}/{LIST}").type == pafs.FileType.File:
            with store.open_input_file(f"{where}/{LIST}") as f:
                files = [(f"{self.path}/{name}", size) for name, size in json.loads(f.read())]
        else:  # another program's folder
            files = [(f"{self.path}/{i.base_name}", i.size) for i in store.get_file_info(pafs.FileSelector(where)) if i.base_name.endswith(".warc.gz")]
        return [Range(path, at, min(size, at + self.span), size) for path, size in files for at in range(0, size, self.span)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ.split(", "))])
        store, where = open_store(partition.path)
        rows, held = [], 0
        with store.open_input_file(where) as f:
            for m in Scanner(f, self.chunk).records(partition.start, partition.end):
                row = fields(m) | {"file": partition.path, "file_bytes": partition.size}
                if not self.payload:
                    row["payload"] = None
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held > 4 << 20 or len(rows) == 1024:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``warc``: options path; for writing date, level and fileBytes; for reading rangeBytes and payload (false leaves payloads out)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """The records of the archives at a path, warcinfo records too. See :func:`outermost` for archives that hold archives."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("rangeBytes", range_bytes).option("payload", str(payload).lower()).load(path)


def write_archives(records: DataFrame, path: str, date: str, level: int = 6, file_bytes: int = FILE_BYTES) -> None:
    """Writes records (the columns WRITTEN) to a folder that has none yet."""
    records.sparkSession.dataSource.register(WarcSource)
    names = [f.split()[0] for f in WRITTEN.split(", ")]
    small_batches(records).select(*names).write.format("warc").mode("append").option("date", date).option("level", level).option("fileBytes", file_bytes).save(path)


def outermost(records: DataFrame, strict: bool = True) -> DataFrame:
    """Records without those that lie inside another's bytes.

    A payload that is itself an archive may be stored without compression; a
    range that begins within it takes the inner records for records of the file.
    Where ``strict``, bytes of a file that no record covers (a member that is
    damaged where its header is) are an error. A file's records, of which only
    rows of a bounded file are, are ordered in one window; leave payloads out if they are long.
    """
    by_place = Window.partitionBy("file").orderBy("member_start", F.col("member_end").desc())
    seen = F.coalesce(F.max("member_end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = records.withColumns({"_end": seen, "_last": F.lead("member_start").over(by_place).isNull()})
    gap = (F.col("member_start") > F.col("_end")) | (F.col("_last") & (F.greatest("member_end", "_end") < F.col("file_bytes")))
    if strict:
        out = out.where(F.when(gap, F.raise_error(F.concat(F.lit("bytes without a record in "), "file"))).otherwise(F.lit(True)).cast("boolean"))
    return out.where(F.col("member_start") >= F.col("_end")).drop("_end", "_last")


def _page_urn(page: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")))


def plan(pages: DataFrame, least: int = LEAST_BYTES, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """A record (the columns WRITTEN) per page: of equal payloads of ``least`` bytes and more the page with the largest id is the response, the others revisit it.

    Only digests and sizes are grouped. Pages are joined to the digests that
    occur twice: by a broadcast if that table is small by the size of its files, and
    otherwise dealt by digest and a further hash, so that copies of one page are spread over many tasks.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").alias("page"), F.col("url").alias("target_uri"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    best = F.max(F.struct(F.col("page").isNotNull().alias("named"), "page", F.coalesce("target_uri", F.lit("")).alias("uri"))).alias("best")
    copies = rows.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), best).where("n > 1").drop("n")
    kept, path = keep(copies, "copies")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    small = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength() <= broadcast_bytes
    keys = ["digest", "payload_bytes"]
    joined = rows.join(F.broadcast(kept), keys, "left") if small else join_spread(rows, kept, keys, ["page", "target_uri"], "left")
    own = F.col("best").isNull() | (F.col("page").eqNullSafe(F.col("best.page")) & (F.coalesce("target_uri", F.lit("")) == F.col("best.uri")))
    return joined.select(
        _page_urn(F.col("page")).alias("record_id"), F.when(own, "response").otherwise("revisit").alias("record_type"), "target_uri", F.when(~own, _page_urn(F.col("best.page"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"), "payload_bytes", F.when(own, F.col("html").cast("binary")).alias("payload"),
    )


def archive(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least: int = LEAST_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes a record per page (page_id, url, html) and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, file, member_start, member_end.

    A null html is an empty payload; null ids count as smaller than all others,
    and come back as null. Of several rows with the largest id, the greatest url is
    the response; rows that repeat both are responses too. Null urls have no
    header, line ends in urls come back as %0D and %0A. Other columns are ignored. An empty
    table gives an empty result. All comes from the archives: a response's digest
    and size from its payload, a revisit's from its headers.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(plan(pages, least), path, date)
    found = outermost(read_archives(spark, path, range_bytes, payload=False)).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"), "file", "member_start", "member_end")
