"""Legacy ARC archives to WARC, written and read with Spark's own file sinks.

An ARC file begins with a version block whose first line is a `filedesc://` record header. Version 1 headers have five fields (URL, IP address,
date, content type, length), version 2 headers have ten (URL, IP address, date, content type, result code, checksum, location,
offset, file name, length). Every header is parsed by the version that the file declares, and the record is exactly as long as its header says,
so payloads may hold anything. For each record an equivalent WARC record is synthesised: a
deterministic record id, the date in WARC's form, type, block and payload digests.

Equal payloads of at least LEAST_REVISIT bytes are stored once: the record with the smallest id is the response, the others are revisits of it. Which is
which comes from a shuffle of digests alone, pre-aggregated; the payloads move once, to be joined with that table.

A WARC file is the concatenation of records, each ended by two CR LF. Spark's text sink writes exactly that when the line separator is two CR LF, so
archives go to any store that Spark can write, with its commit protocol; each is one gzip stream, and readers take
them as binary files, whose size is bounded by bytes (see `write_warc`).

Null html is an empty payload, and payloads of any length are kept whole. A null id sorts last. Of rows with one id and equal payloads (repeated rows, ties) all are responses or all revisits.
An empty table gives no records. Extra columns, whatever their names, are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path

#: Payloads below this many bytes are never revisits. Bytes of one ARC image and of records that are written together, about; such packs in one archive.
LEAST_REVISIT, IMAGE_BYTES, PACK_BYTES, PACKS = 100, 4 << 20, 4 << 20, 16
END = b"\r\n\r\n"
ID_HEADER = "X-Record-Key"
RECORD_SCHEMA = "key bigint, url string, date string, kind string, length bigint, digest string, block binary, error string"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes


# The header lines of the two versions of the format.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"


def write_arc(records: Iterator[ArcRecord], version: int, name: str = "made.arc", date: str = "20240101000000") -> bytes:
    """An uncompressed ARC image."""
    head = f"{version} 0 dupsift\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(head)}\n".encode(), head, b"\n"]
    for r in records:
        url = r.url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "-"
        out += [f"{url} {r.ip} {r.date} {r.mime}{middle} {len(r.body)}\n".encode(), r.body, b"\n"]
    return b"".join(out)


#: Record headers of each version. URL and content type may hold blanks, so lines are read from both ends: the last date behind an address divides them.
_HEADERS = {
    b"1": re.compile(rb"(.+) (\S+) (\d{4,14}) (.*) (\d+)"),
    b"2": re.compile(rb"(.+) (\S+) (\d{4,14}) (.*) (?:\d+|-) \S+ \S+ (?:\d+|-) \S+ (\d+)"),
}


def expand(image: bytes) -> bytes:
    """The image itself, or what its gzip members hold: usually there is one for each record."""
    if image[:2] != b"\x1f\x8b":
        return image
    out = []
    while image[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(image) + member.flush())
        image = member.unused_data
    return b"".join(out)


def version_block(image: bytes) -> tuple[ArcRecord, bytes, int]:
    """The record that describes the image, its version, and where it ends."""
    end = image.find(b"\n")
    line = image[: max(end, 0)].rstrip(b"\r").split(b" ")
    if not line[0].startswith(b"filedesc:") or not line[-1].isdigit():
        raise ValueError("the image doesn't begin with a version block")
    body = image[end + 1 : end + 1 + int(line[-1])]
    version = body.split(b" ", 1)[0]
    if version not in _HEADERS:
        raise ValueError(f"unknown version {version!r}")
    url, ip, date = (x.decode("utf-8", "replace") for x in (*line[:3], b"", b"")[:3])
    return ArcRecord(url, ip, date if date.isdigit() else "", "text/plain", body), version, end + 1 + len(body)


def read_arc(image: bytes, bad: list[tuple[int, str]] | None = None) -> Iterator[ArcRecord]:
    """The records of an image, without the version block. Where a header doesn't fit the declared version or a record is cut short: ValueError, or with
    a list `bad` a note there (byte, reason), and reading goes on at the next line that is a header of a whole record."""
    _, version, at = version_block(image)
    header = _HEADERS[version]
    while at < len(image):
        if image[at : at + 1] in b"\r\n":  # what separates records
            at += 1
            continue
        found, end = _record(image, at, header)
        if isinstance(found, ArcRecord):
            yield found
            at = end
        elif bad is None:
            raise ValueError(f"{found} at byte {at}")
        else:
            bad.append((at, found))
            at = image.find(b"\n", at) + 1 or len(image)
            while at < len(image) and not (isinstance((next_ := _record(image, at, header))[0], ArcRecord) and image[next_[1] : next_[1] + 1] in (b"", b"\n", b"\r")):
                at = image.find(b"\n", at) + 1 or len(image)


def _record(image: bytes, at: int, header: re.Pattern) -> tuple[ArcRecord | str, int]:
    """The record that begins at a byte, or what is wrong there; and where it ends."""
    end = image.find(b"\n", at)
    if end < 0:
        return "a header line without end", end
    m = header.fullmatch(image[at:end].rstrip(b"\r"))
    if not m:
        return "a header that doesn't fit the version", end
    size = int(m[5])
    if end + 1 + size > len(image):
        return "a record cut short", end
    url, ip, date, mime = (x.decode("utf-8", "replace") for x in m.groups()[:4])
    return ArcRecord(url, ip, date, mime, image[end + 1 : end + 1 + size]), end + 1 + size


def warc_date(arc: str) -> str:
    """YYYYMMDDhhmmss as YYYY-MM-DDThh:mm:ssZ; shorter dates are filled up."""
    full = arc + "00000101000000"[len(arc) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Head (with the empty line) and payload of a response."""
    at = body.find(END)
    return (body[: at + 4], body[at + 4 :]) if at >= 0 else (b"", body)


def _header(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(name.lower().encode() + b":"):
            return line.split(b":", 1)[1].strip().decode()
    return None


def convert(images: DataFrame) -> DataFrame:
    """Rows with a binary `content` (ARC images, as binaryFile reads them) to the records in them: key (the number in the response's
    X-Record-Key, else null), url, date (WARC's form), kind (mime), length and digest (SHA-256, hex) of the payload, block; and error. The version
    block comes as a record whose url begins with filedesc. A bad record, or an image without a version block, is a row with error set and nothing else, so it doesn't fail the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image in b.column(0):
                rows, bad, plain = [], [], expand(image.as_py())
                try:
                    info = version_block(plain)[0]
                    rows.append((None, info.url, warc_date(info.date), info.mime, len(info.body), hashlib.sha256(info.body).hexdigest(), info.body, None))
                    for r in read_arc(plain, bad):
                        head, payload = split_http(r.body)
                        key = _header(head, ID_HEADER)
                        rows.append((int(key) if key else None, r.url, warc_date(r.date), r.mime, len(payload), hashlib.sha256(payload).hexdigest(), r.body, None))
                except ValueError as e:
                    bad.append((0, str(e)))
                rows += [(*[None] * len(_NAMES), f"{why} at byte {at}") for at, why in bad]
                yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate([*_ARROW, pa.string()])], names=[*_NAMES, "error"])

    return images.select("content").mapInArrow(run, RECORD_SCHEMA)


_ARROW = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
_NAMES = ["key", "url", "date", "kind", "length", "digest", "block"]


def pages_to_arc(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """ARC images (column content) of crawled pages, version 1 and 2 by turns; each holds about IMAGE_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, records, size = 0, [], 0

        def image() -> pa.RecordBatch:
            return pa.record_batch([pa.array([write_arc(iter(records), 1 + made % 2)], pa.binary())], names=["content"])

        for b in batches:
            for key, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                line = "" if key is None else f"{ID_HEADER}: {key}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{line}\r\n".encode() + (html or "").encode()
                records.append(ArcRecord(url or "-", "0.0.0.0", "20240101000000", "text/html", body))
                size += len(body)
                if size >= IMAGE_BYTES:
                    yield image()
                    made, records, size = made + 1, [], 0
        if records:
            yield image()

    return pages.select(id_col, "url", "html").mapInArrow(run, "content binary")


def mark_revisits(records: DataFrame) -> DataFrame:
    """records (without errors) with refers_to (the key of the response with the equal payload; null for responses) and its url and date."""
    records = records.where("error IS NULL").drop("error")
    first = (
        records.where(F.col("length") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "url", "date")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("d"), F.struct(F.col("first.key").alias("key"), F.col("first.url").alias("url"), F.col("first.date").alias("date")).alias("first"))
    )
    # The side with payloads may have a hot digest; the other has one row for each, so adaptive execution can split the hot one.
    joined = records.join(first, (F.col("digest") == F.col("d")) & (F.col("length") >= LEAST_REVISIT), "left")
    other = F.col("first").isNotNull() & ~F.col("first.key").eqNullSafe(F.col("key"))
    return joined.select(*records.columns, F.when(other, F.col("first")).alias("first"))


def warc_record(key: int | None, url: str, date: str, mime: str, length: int, digest: str, block: bytes, first: dict | None) -> bytes:
    """One record, without the two CR LF that end it."""
    uid = lambda k, u, d: uuid.uuid5(uuid.NAMESPACE_URL, f"{k} {u} {d} {digest}").urn
    about = url.startswith("filedesc:")
    head, _ = split_http(block)
    if about:  # what the version block says, as fields
        head, mime = b"", "application/warc-fields"
        named = url.split("/")[-1]
        block = f"isPartOf: {named}\r\nconvertedFrom: {block.splitlines()[0].decode('utf-8', 'replace') if block else ''}\r\n".encode()
    if first:
        block = head
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if first else 'warcinfo' if about else 'response' if head else 'resource'}",
        f"WARC-Record-ID: <{uid(key, url, date)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"Content-Type: {'application/http; msgtype=response' if head else mime}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Payload-Length: {length}",
    ]
    if key is not None:
        lines.append(f"{ID_HEADER}: {key}")
    if first:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{uid(first['key'], first['url'], first['date'])}>",
            f"WARC-Refers-To-Target-URI: {first['url']}",
            f"WARC-Refers-To-Date: {first['date']}",
            f"X-Refers-To-Key: {first['key']}",
        ]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block


def write_warc(marked: DataFrame, path: str) -> None:
    """Archives at path: gzip streams of at most PACKS packs. A pack is a row for the text sink and ends with the record that brings it to PACK_BYTES, so
    an archive has at most PACKS times (PACK_BYTES and the largest record) before compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                pack.append(warc_record(*(r[n] for n in (*_NAMES, "first"))))
                size += len(pack[-1])
                if size >= PACK_BYTES:
                    yield pa.record_batch([pa.array([END.join(pack)], pa.binary())], names=["value"])
                    pack, size = [], 0
        if pack:
            yield pa.record_batch([pa.array([END.join(pack)], pa.binary())], names=["value"])

    raw = marked.select(*_NAMES, "first").mapInArrow(run, "value binary")
    # The cast takes the bytes as they are; nothing decodes them.
    raw.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", PACKS).text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; only declared lengths decide where a block ends."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("a block cut short")
        yield headers, block


def read_warc(spark, path: str) -> DataFrame:
    """key, record_id, uri, date, record_type, payload_bytes, payload_digest, refers_to of each record of the archives. The digest of a
    stored payload is computed anew; a mismatch with the declared one is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)):
                    if h["warc-type"] == "warcinfo":
                        rows.append((None, h["warc-record-id"], h["warc-target-uri"], h["warc-date"], "warcinfo", len(block), None, None))
                        continue
                    digest, length = h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"])
                    if h["warc-type"] != "revisit":
                        payload = split_http(block)[1] if h["warc-type"] == "response" else block
                        if (len(payload), hashlib.sha256(payload).hexdigest()) != (length, digest):
                            raise ValueError(f"the payload of {h['warc-record-id']} isn't what its digest says")
                    number = lambda name, h=h: int(h[name]) if h.get(name, "None") != "None" else None
                    rows.append((number(ID_HEADER.lower()), h["warc-record-id"], h["warc-target-uri"], h["warc-date"], h["warc-type"], length, digest, number("x-refers-to-key")))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["key", "record_id", "uri", "date", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    schema = "key bigint, record_id string, uri string, date string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """What op5 returns: pages as ARC images, converted, marked, written as WARC, read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(mark_revisits(convert(pages_to_arc(pages))), path)
    return read_warc(pages.sparkSession, path).where("record_type <> 'warcinfo'").select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= {LEAST_REVISIT} GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, d.h AS payload_digest, CASE WHEN n >= {LEAST_REVISIT} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_REVISIT} AND first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h
"""
