"""Legacy ARC archives converted to WARC, written as archives and read back.

`to_arc` lays pages out as ARC bytes (version 1 or 2). `convert` parses them: the version block
names the fields of the record lines, a record's last field declares its length, and each record
becomes the fields of a WARC record with a made identifier (from archive name and offset, so
that a repeated task makes the same), timestamp, type and payload digest. `write` stores WARC
records as archives of gzip members in a shared folder; of records with equal payloads of at
least `least` bytes, that with the smallest id is a response and the others revisit it. `read`
reads archives back by the lengths they declare.

Payloads travel once: only digests are grouped, and payloads that occur twice or more are few
(or are joined by shuffle, where Spark splits hot payloads). Archives hold about ARCHIVE_BYTES
of records, or one longer record, so a task holds one archive at a time.

Null payloads count as empty. Rows with a null id are responses, unless a row with an id has the
same payload; rows that share the smallest id are all responses. Null urls are written as `-`.
White space in urls is percent-encoded, as both formats demand. A record cut off by the end of its
archive is kept as far as it goes and marked as truncated; what follows a line that is no record
line is given as one record of type `unreadable`. Empty tables write one empty folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import count
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.common import if_small, slices
from tallymill.session import durable, shared_folder

ARCHIVE_BYTES = 8 << 20
FEED = 1 << 15
# Record lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       "Archive-length",
}
ARC_SCHEMA = "name string, content binary"
RECORD_SCHEMA = ("id long, record_id string, record_type string, uri string, date string, ip string, "
                 "content_type string, head binary, payload binary, payload_digest string, "
                 "truncated boolean")
READ_SCHEMA = ("id long, record_id string, record_type string, uri string, date string, "
               "refers_to long, payload_bytes long, payload_digest string, payload binary")
_ID = re.compile(rb"^X-Page-Id: (-?\d+)\r?$", re.M)
_LENGTH = re.compile(rb"^Content-Length: (\d+)\r?$", re.M | re.I)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC ---


def _http_head(payload: bytes, page_id: int | None) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own
            + b"Content-Length: %d\r\n\r\n" % len(payload))


def arc_archive(name: str, records: list[tuple[str, int | None, bytes]], date: str,
                version: int) -> bytes:
    """An ARC archive of (url, id, payload) records, each an HTTP response."""
    about = f"{version} 0 tallymill\n{ARC_FIELDS[version]}\n".encode()
    v2 = version == 2
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {'200 - - 0 ' + name + ' ' if v2 else ''}"
           f"{len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for url, page_id, payload in records:
        head = _http_head(payload, page_id)
        place = quote(url, safe="".join(map(chr, range(33, 127)))) or "-"
        middle = f"200 {sha1_base32(payload)} - {at} {name} " if v2 else ""
        line = f"{place} 0.0.0.0 {date} text/html {middle}{len(head) + len(payload)}\n".encode()
        out += [line, head, payload, b"\n"]
        at += len(line) + len(head) + len(payload) + 1
    return b"".join(out)


def to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
           date: str = "20240101000000") -> DataFrame:
    """(name, content): pages as ARC archives, of version 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count()
        for batch in batches:
            for part in slices(batch, payload, ARCHIVE_BYTES):
                i = next(number)
                rows = [(u or "", k, (p or "").encode()) for k, u, p in
                        zip(*(part.column(c).to_pylist() for c in (key, url, payload)))]
                first = next((str(k) for _, k, _ in rows if k is not None), "none")
                name = f"pages-{first}-{len(rows)}-{i}.arc"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([arc_archive(name, rows, date, 1 + i % 2)])],
                    ["name", "content"])

    return pages.select(F.col(key).cast("long").alias(key), url, payload).mapInArrow(run, ARC_SCHEMA)


def arc_records(name: str, content: bytes) -> Iterator[dict]:
    """The records of an ARC archive as WARC fields."""
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(content):
        if content[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = content.find(b"\n", at)
        line = content[at:stop if stop >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        made = hashlib.sha1(f"{name} {at}".encode()).digest()[:16]
        record = {"record_id": f"urn:uuid:{uuid.UUID(bytes=made, version=5)}"}
        # The first line of an archive may be of either version; its block then tells.
        expected = {len(x.split()): x.split() for x in ARC_FIELDS.values()} if at == 0 else {
            len(fields): fields}
        if stop < 0 or len(values) not in expected or not values[-1].isdigit():
            yield {**record, "record_type": "unreadable", "head": b"", "payload": content[at:],
                   "truncated": False, "payload_digest": sha1_base32(content[at:])}
            return
        named = dict(zip(expected[len(values)], values))
        begin = stop + 1
        block = content[begin:begin + int(values[-1])]
        leading = at == 0
        record |= {"uri": named["URL"], "ip": named["IP-address"], "truncated":
                   len(block) < int(values[-1]), "content_type": named["Content-type"]}
        d = named["Archive-date"].ljust(14, "0")
        record["date"] = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        at = begin + len(block)
        if leading and named["URL"].startswith("filedesc:"):  # elsewhere it is the url of a page
            lines = block.decode("utf-8", "replace").split("\n")
            if len(lines) > 1 and lines[1].startswith("URL "):
                fields = lines[1].split()
            yield {**record, "record_type": "warcinfo", "head": b"", "payload": block,
                   "payload_digest": sha1_base32(block)}
            continue
        head = b""
        if block.startswith(b"HTTP/"):
            end = block.find(b"\r\n\r\n")
            head = block[:end + 4] if end >= 0 else block
        payload = block[len(head):]
        found = _ID.search(head)
        yield {**record, "record_type": "response" if head else "resource", "head": head,
               "payload": payload, "payload_digest": sha1_base32(payload),
               "id": int(found[1]) if found else None}


def _in_parts(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded bytes."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row.get("payload") or b"")
        if size > ARCHIVE_BYTES:
            yield pa.RecordBatch.from_pylist(part, schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def convert(archives: DataFrame) -> DataFrame:
    """ARC archives (name, content) as rows of WARC fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(RECORD_SCHEMA)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _in_parts(arc_records(name, content.as_py() or b""), schema)

    return archives.select("name", "content").mapInArrow(run, RECORD_SCHEMA)


# --- WARC ---


def warc_record(row: dict) -> bytes:
    """One WARC record. A revisit holds the headers of its response, not the payload."""
    kind = "resource" if row["record_type"] == "unreadable" else row["record_type"]
    refers = row.get("refers_to")
    block = row["head"] + (b"" if refers is not None else row["payload"])
    mime = {"response": "application/http; msgtype=response", "warcinfo": "application/warc-fields"}
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if refers is not None else kind}",
            f"WARC-Record-ID: <{row['record_id']}>", f"Content-Length: {len(block)}",
            f"Content-Type: {mime.get(kind, row['content_type'] or 'application/octet-stream')}",
            f"WARC-Date: {row['date'] or '1970-01-01T00:00:00Z'}",
            f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
            f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if row["uri"] not in (None, "-"):
        head.append(f"WARC-Target-URI: {row['uri']}")
    if row["truncated"]:
        head.append("WARC-Truncated: unspecified")
    if row["id"] is not None:
        head.append(f"X-Page-Id: {row['id']}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                 f"X-Refers-To-Page-Id: {refers}", f"X-Payload-Length: {len(row['payload'])}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def repeated_payloads(pages: DataFrame, key: str = "page_id", payload: str = "html",
                      least: int = 0) -> DataFrame:
    """(payload_sha, refers_to) of payloads that several rows have, with the smallest id."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    return pages.where(F.octet_length(body) >= least).select(
        F.sha2(body, 256).alias("payload_sha"), F.col(key).cast("long").alias("id")).groupBy(
        "payload_sha").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").drop("n")


def write(records: DataFrame, repeated: DataFrame, folder: str) -> None:
    """Store WARC fields as gzip archives in `folder`.

    An archive is written as one text of raw bytes. It ends with an empty gzip member, whose
    last byte is zero; Spark's line end supplies that byte.
    """
    linked = records.withColumn("payload_sha", F.sha2("payload", 256)).join(
        if_small(repeated), "payload_sha", "left").drop("payload_sha")
    own = F.col("record_type") == "response"
    later = F.col("id").isNull() | (F.col("id") > F.col("refers_to"))
    linked = linked.withColumn("refers_to", F.when(own & later, F.col("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "payload", ARCHIVE_BYTES):
                packed = b"".join(gzip_member(warc_record(row)) for row in part.to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([packed + gzip_member(b"")[:-1]])],
                                                 ["content"])

    linked.mapInArrow(run, "content binary").select(F.col("content").cast("string")).write.options(
        lineSep="\0", maxRecordsPerFile=1).text(folder)


def members(content: bytes) -> Iterator[bytes]:
    """The unpacked gzip members of an archive."""
    view, at = memoryview(content), 0
    while at < len(content):
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof and at < len(content):
            piece = view[at:at + FEED]
            parts.append(reader.decompress(piece))
            at += len(piece)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def warc_fields(record: bytes) -> dict | None:
    """A WARC record as a row of READ_SCHEMA; None for an empty member. The payload of a revisit
    is that of the record it refers to, so only its length and digest are known here."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = record[:end].decode("utf-8", "replace").split("\r\n")[1:]
    head = dict(line.split(": ", 1) for line in lines)
    block = record[end + 4:end + 4 + int(head["Content-Length"])]
    kind, payload = head["WARC-Type"], block
    if block.startswith(b"HTTP/"):
        payload = block[block.find(b"\r\n\r\n") + 4:]
    number = lambda name: int(head[name]) if name in head else None
    declared = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "revisit":
        digest, size, payload = declared, number("X-Payload-Length"), None
    else:
        digest, size = sha1_base32(payload), len(payload)
        if digest != declared:
            raise ValueError(f"{head['WARC-Record-ID']}: payload digest {digest}, declared {declared}")
    return {"id": number("X-Page-Id"), "record_id": head["WARC-Record-ID"].strip("<>"),
            "record_type": kind, "uri": head.get("WARC-Target-URI"), "date": head.get("WARC-Date"),
            "refers_to": number("X-Refers-To-Page-Id"), "payload_bytes": size,
            "payload_digest": digest, "payload": payload}


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives in `folder`."""
    schema = READ_SCHEMA if with_payload else READ_SCHEMA.removesuffix(", payload binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = _arrow(schema)
        for batch in batches:
            for content in batch.column(0):
                rows = (warc_fields(x) for x in members(content.as_py()))
                rows = ({n: r[n] for n in shape.names} for r in rows if r)
                yield from _in_parts(rows, shape)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)


def archived(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """Pages as ARC archives, converted, stored as WARC archives, and read back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/tallymill/warc-{uuid.uuid4().hex}"
    repeated = durable(repeated_payloads(pages, key, payload, least))
    write(convert(to_arc(pages, key, "url", payload)), repeated, folder)
    return read(spark, folder).where(F.col("record_type").isin("response", "revisit"))
