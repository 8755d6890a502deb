"""WARC archives: a writer and a splittable reader (operator 5).

Writer: one gzip member per record.  Pages with equal payloads of at least
``MIN_REVISIT_BYTES`` bytes keep one ``response`` record (the largest page_id);
the others become ``revisit`` records that name it and carry no payload.  A
task writes archives under names of its own and reports them; the manifest, a
table that Spark commits, lists those of successful tasks only, so what a lost
or repeated task left behind is never read.

Reader: archives are cut into byte ranges.  A task scans its range for the gzip
magic, takes a candidate for a member only if it decodes to a WARC version line,
and owns the records whose member starts inside its range, reading on past the
end of the range to finish the last one.  After a valid member the scan goes on
at its end, so magic bytes inside compressed data are met at most once a range
and fail the test there.

Files are opened through ``pyarrow.fs`` by URI in the folder that all executors
share.

Edge cases: a null html is the empty payload; a null url has no target header;
among equal payloads a null page_id is below any other, and copies without any
page_id are all responses; rows that share the largest page_id and the payload
are all responses; line ends in urls are percent-encoded; an empty table writes
no archive and reads no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import bounded_batches, read_table, written

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 32 << 20
READ_BYTES = 1 << 20
DECODE_BYTES = 16 << 10
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html with payload digest, size, record_type and refers_to."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).select(
        "*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("bigint").alias("size")
    )
    first = (
        rows.where(F.col("size") >= MIN_REVISIT_BYTES)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("kept").isNotNull())
        .drop("n")
    )
    joined = rows.hint("merge").join(first, ["digest", "size"], "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("kept")).alias("refers_to"),
    )


def record_id(page_id, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def make_record(page_id, url, html: str, digest: str, kind: str, refers_to) -> bytes:
    """One gzip member holding one record."""
    payload = html.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    text = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip_member(text)


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``record_types`` rows; returns the manifest (path, bytes, records)."""
    bounded_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        out = None
        done: list[tuple[str, int, int]] = []
        name, size, n = "", 0, 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                member = make_record(*row)
                out.write(member)
                size += len(member)
                n += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((name, size, n))
        if out is not None:
            out.close()
            done.append((name, size, n))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{folder}/{d[0]}" for d in done], pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
            ],
            names=["path", "bytes", "records"],
        )

    rows = records.select("page_id", "url", "html", "digest", "record_type", "refers_to")
    return written(rows.mapInArrow(run, "path string, bytes bigint, records bigint"), "warc-manifest")


class Window:
    """Random reads of one file through a buffer."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size
        self.start, self.data = 0, b""

    def load(self, at: int, least: int) -> int:
        """Have the buffer hold ``least`` bytes from ``at`` on (fewer at the end of the file); their place in it."""
        if not self.start <= at <= at + least <= self.start + len(self.data) and at < self.size:
            self.stream.seek(at)
            self.start, self.data = at, self.stream.read(min(max(READ_BYTES, least), self.size - at))
        return at - self.start

    def read(self, at: int, n: int) -> memoryview:
        """At most ``n`` bytes from ``at`` on; none at the end of the file."""
        if at >= self.size:
            return memoryview(b"")
        k = self.load(at, 1)
        return memoryview(self.data)[k : k + n]


def is_record(data: bytes) -> bool:
    """Whether ``data`` begins with a whole WARC record: version, type and
    length, and a block of that length."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not _VERSION.match(head):
        return False
    fields = {line.partition(b":")[0].strip().lower(): line.partition(b":")[2].strip() for line in head.split(b"\r\n")[1:]}
    size = fields.get(b"content-length", b"")
    return b"warc-type" in fields and size.isdigit() and int(size) <= len(rest)


def decode_member(window: Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member that starts at ``at`` and its end, if it is a WARC one.

    A record that the end of the file cuts off is an error, not a missing one.
    """
    z = zlib.decompressobj(31)
    out: list[bytes] = []
    pos, checked = at, False
    while not z.eof:
        chunk = window.read(pos, DECODE_BYTES)
        if not chunk:
            if checked:
                raise ValueError(f"the archive ends inside the record at offset {at}")
            return None
        try:
            part = z.decompress(chunk)
        except zlib.error:
            return None
        pos += len(chunk)
        out.append(part)
        if not checked and sum(map(len, out)) >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            checked = True
    data = b"".join(out)
    return (data, pos - len(z.unused_data)) if checked and is_record(data) else None


_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")


def find_magic(window: Window, at: int, end: int) -> int:
    """Offset of the first gzip magic at or after ``at`` and before ``end``, or -1."""
    while at < end and at + len(MAGIC) <= window.size:
        k = window.load(at, len(MAGIC))
        found = window.data.find(MAGIC, k)
        if found >= 0:
            at = window.start + found
            return at if at < end else -1
        at = max(at + 1, window.start + len(window.data) - len(MAGIC) + 1)
    return -1


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a member."""
    while data.startswith(b"WARC/"):
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = {}
        for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields.get("content-length", "0"))
        yield fields, rest[:size]
        data = rest[size:].lstrip(b"\r\n")


def records_in_range(stream, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, fields and block of the records whose member starts in [start, end)."""
    window, at = Window(stream, size), start
    while (found := find_magic(window, at, end)) >= 0:
        member = decode_member(window, found)
        if member is None:
            at = found + 1
            continue
        data, at = member
        for fields, block in split_records(data):
            yield found, fields, block


def byte_ranges(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))
    return manifest.where("bytes > 0").select(
        "path", "bytes", F.explode(starts).alias("start"), F.lit(range_bytes).cast("bigint").alias("length")
    )


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives in ``manifest`` (path, bytes), one row each.

    ``payload_bytes`` and ``payload_digest`` describe the full payload: of a
    response they are computed from the block, of a revisit they are those its
    headers state.  ``payload`` is null unless asked for.
    """
    schema = "path string, at bigint, record_type string, record_id string, url string, refers_to_id string, payload_bytes bigint, payload_digest string, payload binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def one(path: str, at: int, fields: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = fields.get("warc-type")
        if kind == "revisit":
            stated = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(stated[0]) if stated else None
            digest = base64.b32decode(fields["warc-payload-digest"].split(":")[1]).hex()
        else:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        url, refers = fields.get("warc-target-uri"), fields.get("warc-refers-to")
        return path, at, kind, fields.get("warc-record-id"), url, refers, size, digest, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start, length in zip(*[c.to_pylist() for c in b.columns]):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as stream:
                    rows: list[tuple] = []
                    held = 0
                    for found, fields, block in records_in_range(stream, size, start, min(start + length, size)):
                        rows.append(one(path, found, fields, block))
                        held += len(block)
                        if len(rows) == 512 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    ranges = byte_ranges(manifest, range_bytes).repartition("path", "start")
    return ranges.mapInArrow(run, schema)


def page_of(name: str):
    """The page id inside a record id written by ``record_id``."""
    return F.nullif(F.regexp_extract(F.col(name), "^<urn:x-page:(-?[0-9]*):", 1), F.lit("")).cast("bigint")


def archive_pages(pages: DataFrame, folder: str, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` and read them back.

    Page ids are integers (record ids are made of them); other types are an error.
    """
    if not isinstance(pages.schema["page_id"].dataType, T.IntegralType):
        raise TypeError(f"page_id must be an integer, not {pages.schema['page_id'].dataType.simpleString()}")
    manifest = write_archives(record_types(pages), folder)
    back = read_archives(manifest, range_bytes, with_payload)
    return back.where(F.col("record_type").isin("response", "revisit")).select(
        page_of("record_id").alias("page_id"),
        "url",
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of("refers_to_id").alias("refers_to"),
        F.col("payload").cast("string").alias("html"),
    )


def op5_warc(spark, sf_dir):
    rows = archive_pages(read_table(spark, sf_dir, "pages"), scratch_path(spark, "llm-warc"), with_payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select payload_digest, max(page_id) as kept from p where octet_length(b) >= {MIN_REVISIT_BYTES} group by payload_digest)
select p.page_id, octet_length(b)::bigint as payload_bytes, payload_digest,
       case when kept is not null and kept <> p.page_id then 'revisit' else 'response' end as record_type,
       case when kept <> p.page_id then kept end as refers_to
from p left join g using (payload_digest)
"""
