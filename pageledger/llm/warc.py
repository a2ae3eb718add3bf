"""Legacy archives to WARC.

``read_arc`` parses ARC files of version 1 (five header fields) and 2 (ten) by their declared lengths, record by record from a gzip or plain stream;
``convert`` gives each record what WARC asks for (identifier, timestamp, type, block and payload digests), turns records with a payload that another
record has into revisits, and writes WARC files with one gzip member a record; ``read_warc`` reads those back.

Files are written by the tasks into the shared folder, each under its own name only when complete, so a task that runs twice leaves the same files. They are read by
Spark's ``binaryFile`` source; a task holds one compressed file and one record at a time.

Defined results: a record whose header or declared length does not fit is given as type ``damaged`` and the rest of its file is left, since nothing after it can be
trusted; the file's own head (``filedesc:``) becomes a ``warcinfo`` record. Empty payloads have the digest of no bytes. Of equal payloads of at least ``least`` bytes the
record with the largest preference is the response (ties: the largest identifier), others refer to it. Missing fields are ``-`` in ARC and left out in WARC.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageledger.llm.common import SharedFile, new_folder, pieces, table_of
from pageledger.session import materialize

#: The field lists of the two versions, and the profile of a revisit.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of records after which a writer begins its next file.
FILE_BYTES = 32 << 20
LEVEL = 3
LEAST = 1000

ARC_SCHEMA = (
    "record_id string, version int, url string, ip string, date string, mime string, status int, type string, head binary, payload binary, payload_digest string, block_digest string, prefer long"
)
ARC_TYPES = pa.schema(
    [("record_id", pa.string()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("status", pa.int32()), ("type", pa.string())]
    + [("head", pa.binary()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("prefer", pa.int64())]
)


def member(data: bytes) -> bytes:
    """One gzip member, always the same bytes for the same data."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


class Rotating:
    """Numbered files of some size of one task."""

    def __init__(self, folder: str, stem: str, head):
        self.folder, self.stem, self.head, self.file, self.count, self.raw = folder, stem, head, None, 0, 0

    def write(self, record: bytes) -> None:
        if self.file is not None and self.raw > FILE_BYTES:
            self.close()
        if self.file is None:
            name = f"{self.stem}-{self.count:05d}"
            self.file, self.count, self.raw = SharedFile(self.folder, f"{name}{'.arc' if 'arc-v' in self.stem else '.warc'}.gz"), self.count + 1, 0
            self.file.write(member(self.head(name)))
        self.file.write(member(record))
        self.raw += len(record)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if content[:2] == b"\x1f\x8b" else raw


# ---------------------------------------------------------------- ARC


def arc_head(name: str, version: int) -> bytes:
    fields = " ".join(FIELDS[version])
    body = f"{version} 0 pageledger\n{fields}\n\n".encode()
    rest = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 19960101000000 text/plain{rest} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, mime: str, status: int, block: bytes, offset: int, name: str) -> bytes:
    start = f"{re.sub(r'\s', '%20', url or '-')} 0.0.0.0 {date} {mime}"
    middle = "" if version == 1 else f" {status} {hashlib.md5(block).hexdigest()} - {offset} {name}"
    return f"{start}{middle} {len(block)}\n".encode() + block + b"\n"


def write_arc(pages: DataFrame, folder: str) -> None:
    """Write ``pages(page_id, url, html)`` as ARC files of both versions in turn. The block is the HTTP response; it names the page in ``X-Page-Id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version = 1 + task % 2
        out = Rotating(folder, f"arc-v{version}-{task:07d}", lambda name: arc_head(name, version))
        n = 0
        for b in (p for batch in batches for p in pieces([batch], "html")):
            for page_id, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist()):
                body = (html or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                out.write(arc_record(version, url, "20200101000000", "text/html", 200, http + body, out.raw, out.stem))
                n += 1
        out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    pages.select("page_id", "url", "html").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def arc_date(text: str) -> str:
    """YYYYMMDDhhmmss, or its beginning, as a WARC timestamp."""
    full = text + "00000101000000"[len(text) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its blank line, body, and header fields by lower-case name."""
    at = block.find(b"\r\n\r\n")
    head, body = (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return head, body, fields


def parse_arc(content: bytes, source: str, prefer_field: str) -> Iterator[tuple]:
    stream, version, offset = opened(content), 1, 0
    while line := stream.readline():
        if not line.strip():
            offset += len(line)
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        first = parts[0].startswith("filedesc:")
        size = int(parts[-1]) if len(parts) in (5, 10) and parts[-1].isdigit() else -1
        if not first and len(parts) != len(FIELDS[version]):
            size = -1
        block = stream.read(size) if size >= 0 else b""
        if size < 0 or len(block) < size:
            yield (str(uuid.uuid5(NAMESPACE, f"{source}:{offset}")), version, None, None, None, None, None, "damaged", line, block, None, None, None)
            return
        url, ip, date, mime = parts[:4]
        kind = "warcinfo" if first else "response" if url.startswith(("http://", "https://")) or block.startswith(b"HTTP/") else "resource"
        head, body, fields = http_parts(block) if kind == "response" else (b"", block, {})
        if first and block[:1] in (b"1", b"2"):
            version = int(block[:1])
        status = int(parts[4]) if version == 2 and len(parts) == 10 and parts[4].isdigit() else None
        value = fields.get(prefer_field.lower(), "")
        yield (
            str(uuid.uuid5(NAMESPACE, f"{source}:{offset}:{url}:{date}")), version, None if url == "-" else url, ip, arc_date(date), mime, status, kind, head, body,
            hashlib.sha1(body).hexdigest(), hashlib.sha1(block).hexdigest(), whole_number(value),
        )
        offset += len(line) + size


def whole_number(text: str) -> int | None:
    """A 64-bit number written in decimal digits, else nothing."""
    n = int(text) if re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def file_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def batched(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weight(r)
        if size > 4 << 20 or len(held) >= 4096:
            yield table_of(held, schema)
            held, size = [], 0
    yield table_of(held, schema)


def read_arc(spark: SparkSession, folder: str, prefer_field: str = "X-Page-Id") -> DataFrame:
    """A row for each record of the ARC files. ``prefer`` is the number in the HTTP field ``prefer_field``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for path, content in zip(b.column("path"), b.column("content")) for r in parse_arc(content.as_py(), file_name(path.as_py()), prefer_field))
        yield from batched(rows, ARC_TYPES, lambda r: len(r[9] or b""))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.arc*").load(folder).select("path", "content").mapInArrow(run, ARC_SCHEMA)


# ---------------------------------------------------------------- WARC


def choose_revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """``payload_digest, refers_to``: the response of every payload that more than one response record has. Combined map-side, one row for a payload."""
    chosen = F.max(F.struct(F.coalesce("prefer", F.lit(-(2**63))).alias("p"), "record_id", "url", "date"))
    same = records.where((F.col("type") == "response") & (F.octet_length("payload") >= least)).groupBy("payload_digest").agg(chosen.alias("m"), F.count("*").alias("n"))
    return same.where("n > 1").select("payload_digest", F.col("m.record_id").alias("refers_to"), F.col("m.url").alias("refers_url"), F.col("m.date").alias("refers_date"))


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> None:
    """Write rows of ``read_arc`` with ``refers_to, refers_url, refers_date`` (null: no revisit)."""

    def info(name: str) -> bytes:
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"), ("WARC-Date", "1996-01-01T00:00:00Z"), ("WARC-Filename", f"{name}.warc.gz"), ("Content-Type", "application/warc-fields")], b"software: pageledger\r\nformat: WARC File Format 1.0\r\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = Rotating(folder, f"records-{TaskContext.get().partitionId():07d}", info), 0
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(name)[i].as_py() for name in b.schema.names}
                if r["type"] in ("damaged", "warcinfo"):
                    continue
                revisit = r["type"] == "response" and r["refers_to"] is not None and r["refers_to"] != r["record_id"]
                block = r["head"] if revisit else r["head"] + r["payload"]
                fields = [
                    ("WARC-Type", "revisit" if revisit else r["type"]), ("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]),
                    ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", base32(bytes.fromhex(r["payload_digest"]))),
                    ("WARC-Block-Digest", base32(hashlib.sha1(block).digest() if revisit else bytes.fromhex(r["block_digest"]))),
                    ("Content-Type", "application/http; msgtype=response" if r["type"] == "response" else r["mime"]),
                ]
                if revisit:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{r['refers_to']}>"), ("WARC-Refers-To-Target-URI", r["refers_url"]), ("WARC-Refers-To-Date", r["refers_date"]), ("WARC-Truncated", "length")]
                out.write(warc_record(fields, block))
                n += 1
        out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    records.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def convert(spark: SparkSession, arc_folder: str, prefer_field: str = "X-Page-Id", least: int = LEAST) -> str:
    """Convert all ARC files of a folder; returns the folder of the WARC files."""
    records = read_arc(spark, arc_folder, prefer_field)
    # stored, so that Spark sees its size: payloads are shuffled only if the table of repeated ones is too large to send to all
    repeated = materialize(choose_revisits(records, least))
    keyed = records.withColumn("_key", F.when((F.col("type") == "response") & (F.octet_length("payload") >= least), F.col("payload_digest")).otherwise(F.col("record_id")))
    folder = new_folder(spark, "warc")
    write_warc(keyed.join(repeated.withColumnRenamed("payload_digest", "_key"), "_key", "left").drop("_key"), folder)
    return folder


WARC_SCHEMA = "record_id string, type string, url string, date string, payload_digest string, refers_to string, http map<string,string>, payload_bytes long, intact boolean"
WARC_TYPES = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string())]
    + [("http", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("intact", pa.bool_())]
)


def bare_id(value: str | None) -> str | None:
    return value[len("<urn:uuid:") : -1] if value else None


def parse_warc(content: bytes) -> Iterator[tuple]:
    stream = opened(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        kind = fields["warc-type"]
        if kind == "warcinfo":
            continue
        _, body, http = http_parts(block) if fields.get("content-type", "").startswith("application/http") else (b"", block, {})
        named = fields.get("warc-payload-digest")
        digest = base64.b32decode(named.removeprefix("sha1:")).hex() if named else None
        whole = base32(hashlib.sha1(block).digest()) == fields.get("warc-block-digest") and len(block) == size
        revisit = kind == "revisit"
        length = int(http.get("content-length", 0)) if revisit else len(body)
        yield (
            bare_id(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), fields.get("warc-date"), digest, bare_id(fields.get("warc-refers-to")), list(http.items()), length,
            whole and (revisit or hashlib.sha1(body).hexdigest() == digest),
        )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the WARC files but ``warcinfo``; ``intact``: length and digests agree with the record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for content in b.column("content") for r in parse_warc(content.as_py()))
        yield from batched(rows, WARC_TYPES, lambda r: 512)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("content").mapInArrow(run, WARC_SCHEMA)


def page_records(pages: DataFrame) -> DataFrame:
    """Pages through ARC and WARC files and back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    arc = new_folder(spark, "arc")
    write_arc(pages, arc)
    page_id: Column = F.expr("try_cast(element_at(http, 'x-page-id') AS BIGINT)")
    back = materialize(read_warc(spark, convert(spark, arc)).withColumn("page_id", page_id))
    target = back.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("target_id"))
    return back.join(target, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("target_id").alias("refers_to"))
