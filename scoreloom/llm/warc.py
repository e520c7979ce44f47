"""WARC archives of fetched pages, and their transactions assembled again.

Each page becomes a response record (or a revisit, whose WARC-Refers-To names the record of
the equal payload), a request and a metadata record that name it in WARC-Concurrent-To; the
page's number stands in the metadata block. Record identifiers are hashes of page, url and
payload, so a task that runs again writes the same ones.

Every record is a gzip member of its own. Tasks gather members into files of bounded bytes,
which Spark's text writer commits, so any file system Spark knows will do: a member ends in
the high byte of its length, 0 below 16 MB, and that byte is the writer's line separator.
Archives are read as binary files and parsed once, by Content-Length; records are then
joined by their identifiers into one row a capture.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._io import saved

#: From this many bytes equal payloads are stored once.
REVISIT_BYTES = 1000
#: Compressed bytes from which a file is full; a file holds one capture at least, and is read by one task.
FILE_BYTES = 16 << 20
#: Bytes of a member at most; a longer record takes several.
MEMBER_BYTES = (1 << 24) - 1
CRLF = b"\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classified(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url and payload as bytes, digest (SHA-1), size, and last (page_id, url): the row of the largest page_id, then url, with an equal payload of at least `least` bytes, null where that page_id is the row's own."""
    own = pages.select("page_id", F.col("url").cast("binary").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # equal payloads meet as digests and ids only
    last = F.max(F.struct("page_id", F.coalesce("url", F.lit(b"")).alias("url"))).alias("last")
    several = own.where(F.col("size") >= least).groupBy("digest").agg(last, F.count("*").alias("n")).where("n > 1").drop("n")
    # written first, so that its size decides the join and a digest of many pages can be split
    several = saved(several, "warc-equal", slim="light")
    return own.join(several, "digest", "left").withColumn("last", F.when(~F.col("last.page_id").eqNullSafe(F.col("page_id")) & (F.col("size") >= least), F.col("last")))


def _record_id(part: bytes, page: str | None, url: bytes | None, digest: str) -> bytes:
    named = b"\x00".join((part, b"null" if page is None else page.encode(), url or b"", digest.encode()))
    return b"<urn:uuid:%s>" % str(uuid.UUID(bytes=hashlib.sha1(named).digest()[:16], version=5)).encode()


def _record(kind: bytes, fields: list[tuple[bytes, bytes | None]], block: bytes) -> bytes:
    """Fields that are None are left out."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, *(name + b": " + value for name, value in fields if value is not None), b"Content-Length: %d" % len(block)]
    return CRLF.join((*lines, b"", block, b"", b""))


def _members(record: bytes, level: int = 4) -> Iterator[bytes]:
    for at in range(0, len(record), MEMBER_BYTES):
        made = zlib.compressobj(level, zlib.DEFLATED, 31)
        yield made.compress(record[at : at + MEMBER_BYTES]) + made.flush()


def _target(url: bytes | None) -> tuple[bytes | None, bytes, bytes]:
    """The url without line breaks, the host, and the path and query."""
    if url is None:
        return None, b"", b"/"
    url = url.replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    _, apart, rest = url.partition(b"://")
    rest = rest.split(b"#", 1)[0] if apart else b""
    host = rest.replace(b"?", b"/").split(b"/", 1)[0]
    path = rest[len(host) :]
    return url, host, path if path.startswith(b"/") else b"/" + path


def _capture(page: str | None, url: bytes | None, payload: bytes, digest: str, last: dict | None, date: bytes) -> bytes:
    """The members of a page's three records."""
    target, host, path = _target(url)
    own = _record_id(b"capture", page, url, digest)

    def fields(own_id: bytes, kind: bytes) -> list[tuple[bytes, bytes | None]]:
        return [(b"WARC-Record-ID", own_id), (b"WARC-Date", date), (b"WARC-Target-URI", target), (b"Content-Type", kind)]

    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    response = [*fields(own, b"application/http; msgtype=response"), (b"WARC-Payload-Digest", b"sha1:" + digest.encode())]
    if last is None:
        main = _record(b"response", response, head + payload)
    else:
        refers = _record_id(b"capture", None if last["page_id"] is None else str(last["page_id"]), last["url"], digest)
        main = _record(b"revisit", [*response, (b"WARC-Profile", PROFILE), (b"WARC-Refers-To", refers)], head)
    beside = (b"WARC-Concurrent-To", own)
    ask = b"GET %s HTTP/1.1\r\nHost: %s\r\n\r\n" % (path, host)
    request = _record(b"request", [*fields(_record_id(b"request", page, url, digest), b"application/http; msgtype=request"), beside], ask)
    note = b"".join(b"%s: %s\r\n" % x for x in ((b"page-id", None if page is None else page.encode()), (b"payload-bytes", b"%d" % len(payload))) if x[1] is not None)
    metadata = _record(b"metadata", [*fields(_record_id(b"metadata", page, url, digest), b"application/warc-fields"), beside], note)
    return b"".join(x for record in (request, main, metadata) for x in _members(record))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Archives the pages (page_id, url, html; other columns are not read) under path.

    A null html is an empty payload, a null url leaves out the target, a null page_id the
    page's number. Payloads and urls may hold any bytes; line breaks in urls are written as
    %0D and %0A. Rows repeated in page_id, url and html are repeated records under one
    identifier. An empty table gives no record.
    """

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, day = [], 0, date.encode()

        def full() -> pa.RecordBatch:
            made = b"".join(held)
            held.clear()
            # the separator of the text writer is the last byte
            return pa.RecordBatch.from_arrays([pa.array([memoryview(made)[:-1]], pa.binary())], ["value"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "last")]
            for i in range(batch.num_rows):
                held.append(_capture(*(c[i].as_py() for c in columns), day))
                size += len(held[-1])
                if size >= file_bytes:
                    yield full()
                    size = 0
        if held:
            yield full()

    own = classified(pages).select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", "last")
    members = own.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.options(lineSep="\x00", maxRecordsPerFile=1).text(path)


class _Inflated(io.RawIOBase):
    """Bytes of one or several gzip members, a piece at a time."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.member, self.held = data, 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        while not self.held:
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
            if self.at >= len(self.data):
                return 0
            piece = self.data[self.at : self.at + (1 << 14)]
            self.at += len(piece)
            self.held = self.member.decompress(piece)
        n = min(len(to), len(self.held))
        to[:n] = self.held[:n]
        self.held = self.held[n:]
        return n


def records_of(data) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """Header fields (names in lower case, values without one blank before them) and block of each record of an archive, gzipped or not."""
    view = memoryview(data)
    stream = io.BufferedReader(_Inflated(view), 1 << 16) if bytes(view[:2]) == b"\x1f\x8b" else io.BytesIO(view)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        fields: dict[str, bytes] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value[1:] if value[:1] == b" " else value
        yield fields, stream.read(int(fields["content-length"]))


_SCHEMA = "kind string, record_id string, concurrent_to string, refers_to_id string, target binary, page_id long, digest string, size long, payload binary, block binary"
_TYPES = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]


def _parsed(fields: dict[str, bytes], block: bytes) -> tuple:
    def text(name: str) -> str | None:
        return fields[name].strip().decode("utf-8", "replace") if name in fields else None

    kind, payload, size, page = text("warc-type"), None, None, None
    digest = (text("warc-payload-digest") or "").removeprefix("sha1:") or None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        block = None
        if kind == "response":
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        else:
            payload = None
    elif kind == "metadata":
        named = next((x[8:].strip() for x in block.split(b"\r\n") if x.lower().startswith(b"page-id:")), b"")
        page = int(named) if named.lstrip(b"-").isdigit() else None
    return kind, text("warc-record-id"), text("warc-concurrent-to"), text("warc-refers-to"), fields.get("warc-target-uri"), page, digest, size, payload, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: kind, record_id, concurrent_to, refers_to_id, target (bytes), page_id (of metadata), digest and size of the full payload, payload (of responses), block (of the others)."""

    @T.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in records_of(content.as_buffer()):
                    rows.append(_parsed(fields, block))
                    size += len(block) + 500
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _SCHEMA)


def _beside(records: DataFrame, capture: str, *columns: Column) -> DataFrame:
    return records.where(F.col("kind").isin("request", "metadata") & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias(capture)).agg(*columns)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One nested row a capture under path: page_id, target, record_type, refers_to, digest, size, payload, requests and metadata (arrays of record_id and block).

    Requests and metadata are joined to the response or revisit that WARC-Concurrent-To names,
    each identifier once; a capture without any has empty arrays and no page_id, and records
    that name no capture give no row. refers_to: page_id of the capture that a revisit's
    WARC-Refers-To names, null where it isn't under path.
    """
    # parsed once, for both sides of the joins
    records = saved(read(spark, path), "warc-records")
    own = F.struct(F.col("record_id").alias("record_id"), F.col("block").alias("block"))
    lists = [F.sort_array(F.collect_set(F.when(F.col("kind") == kind, own))).alias(column) for kind, column in (("request", "requests"), ("metadata", "metadata"))]
    columns = ["record_id", F.col("kind").alias("record_type"), "target", "digest", "size", "payload"]
    responses = records.where("kind = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    # one that names nothing keeps a key of its own
    revisits = records.where("kind = 'revisit'").withColumn("named", F.coalesce("refers_to_id", F.concat(F.lit("none "), F.coalesce("record_id", F.lit("")))))
    revisits = revisits.join(_beside(records, "named", F.max("page_id").alias("refers_to")), "named", "left").select(*columns, "refers_to")
    out = responses.unionByName(revisits).join(_beside(records, "record_id", F.max("page_id").alias("page_id"), *lists), "record_id", "left")
    none = F.array().cast("array<struct<record_id:string,block:binary>>")
    return out.withColumn("requests", F.coalesce("requests", none)).withColumn("metadata", F.coalesce("metadata", none))
