"""WARC archives: a writer through Spark's own file commit, and a splittable reader.

Writer: every page becomes one gzip member holding one WARC record, so an archive can be cut anywhere. Members go through Spark's
text sink as raw bytes, which gives its commit protocol (a lost executor leaves no half archive); the sink's one separator
byte is a zero, the padding that gzip readers skip between members. Of the pages with equal payloads one is
the response and carries the payload; the others are revisit records that name it and carry no payload.

Reader: archives are cut into byte ranges. A task scans its range for the gzip magic, takes a position as a record only if it decodes to
a WARC header, owns the records that start inside its range, and reads past the end for the last one. Inside a record
it has decoded it does not search, so only the first hit of a range needs the test.

Defined results: a null html is an empty payload; equal pages (same id and payload) are all responses if that id is the
group's largest; pages without an id are responses unless a page with an id has their payload; an empty table gives an empty
archive and an empty result. A null url is written as an empty target.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, scratch_path

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one range of the reader covers.
RANGE_BYTES = 4 << 20
_READ = 1 << 18
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
          "payload binary")


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, payload, digest, refers_to): refers_to is the largest page_id with
    the same payload where that is another page and the payload has at least ``min_bytes`` bytes, else null."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.unhex(F.sha1("payload")))
    shared = (
        p.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and response_id is not null")
        .select("digest", "response_id")
    )
    # stored first: both sides of the join are then plain exchanges, and a digest with very many pages can be split
    out = p.join(cut_lineage(shared), "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return out.select("page_id", "url", "payload", "digest", F.when(other, F.col("response_id")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    name = "null" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html;charset=utf-8",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(z.compress(_record(*row)) + z.flush())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``pages`` as gzip-member WARC archives under ``path``, one file per partition."""
    marked = mark_revisits(pages, min_bytes)
    members = marked.mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


def _parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    number = lambda urn: None if urn is None or urn[10:-1] == "null" else int(urn[10:-1])
    size = int(fields["Content-Length"])
    payload = rest[:size]
    if len(payload) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record is not as long as its header says")
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload does not have the digest of its record")
    return (number(fields["WARC-Record-ID"]), unquote(fields["WARC-Target-URI"]), kind, number(fields.get("WARC-Refers-To")),
            digest, int(fields["X-Payload-Length"]), payload if kind == "response" else None)


def _is_record(head: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_of(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """The decoded records whose member starts at a byte in [start, end) of the open archive ``file``."""
    buffer, at = b"", start  # buffer holds the bytes from `at` on

    def more() -> bool:
        nonlocal buffer
        n = min(_READ, size - at - len(buffer))
        if n <= 0:
            return False
        file.seek(at + len(buffer))
        buffer += file.read(n)
        return True

    while True:
        hit = buffer.find(MAGIC)
        if hit < 0:
            keep = buffer[-2:]
            at, buffer = at + len(buffer) - len(keep), keep
            if at >= end or not more():
                return
            continue
        at, buffer = at + hit, buffer[hit:]
        if at >= end:
            return
        while len(buffer) < 512 and more():
            pass
        if not _is_record(buffer[:4096]):
            at, buffer = at + 1, buffer[1:]
            continue
        z, out = zlib.decompressobj(31), []
        while True:
            out.append(z.decompress(buffer))
            at += len(buffer) - len(z.unused_data)
            buffer = z.unused_data
            if z.eof:
                break
            if not more():
                raise ValueError("an archive ends inside a member")
        yield b"".join(out)


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    make = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
    for batch in batches:
        for path, start, end, size in zip(*[c.to_pylist() for c in batch.columns]):
            fs, name = pyarrow.fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with fs.open_input_file(name) as file:
                for raw in records_of(file, start, end, size):
                    rows.append(_parse(raw))
                    held += len(raw)
                    if held > 8 << 20:
                        yield make(rows)
                        rows, held = [], 0
            if rows:
                yield make(rows)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives under ``path`` (see RECORD); payload is null for a revisit."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select(
        F.regexp_replace("path", "^file:/(?=[^/])", "file:///").alias("path"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"),
        "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end"), "length")
    return ranges.repartition("path", "start").mapInArrow(_read_ranges, RECORD)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
