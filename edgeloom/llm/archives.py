"""Legacy ARC archives converted to WARC records, written, and read back.

An ARC file is a sequence of records, each one header line and as many bytes
as the line declares. Version 1 lines have five fields, version 2 lines ten.
A WARC record gets what ARC lacks: an identifier, an ISO timestamp, a type and
digests, all functions of the record, so that a retried task repeats them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.storage import shared_path, stored, table

# Fields of header lines, and the profile of revisit records.
FIELDS_V1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

MIN_REVISIT = 1000  # bytes of payload from which a copy becomes a revisit
RECORDS_PER_FILE = 20_000
FILE_BYTES = 128_000_000  # of records before compression; a file holds one record at least
BATCH_BYTES = 4_000_000
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:edgeloom:arc-record")


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes) -> bytes:
    """One ARC record of either version."""
    url = url.replace("\n", "%0A").replace("\r", "%0D").replace(" ", "%20") or "-"
    head = [url, ip, date, mime] + (["200", "-", "-", "0", "-"] if version == 2 else []) + [str(len(block))]
    return " ".join(head).encode() + b"\n" + block + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 edgeloom\n{FIELDS_V2 if version == 2 else FIELDS_V1}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", body)


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file: the fields of each line by name, and ``block``.

    The version block names the fields of the lines that follow. Broken
    lengths end the file; what was complete before is returned.
    """
    at, fields = 0, None
    while at < len(content):
        if content[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            return
        parts = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        try:
            length = int(parts[-1])
        except ValueError:
            return
        block = content[end + 1:end + 1 + length]
        if length < 0 or len(block) < length:
            return
        at = end + 1 + length
        if parts[0].startswith("filedesc://"):
            lines = block.decode("utf-8", "replace").split("\n")
            fields = lines[1].strip().split(" ") if len(lines) > 1 and lines[1].strip() else None
            continue
        names = fields or (FIELDS_V2 if len(parts) >= 10 else FIELDS_V1).split(" ")
        extra = len(parts) - len(names)
        if extra > 0:  # spaces in the URL
            parts = [" ".join(parts[:extra + 1]), *parts[extra + 1:]]
        yield dict(zip(names, parts, strict=False)) | {"block": block}


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its empty line) and payload; a block without one is all payload."""
    if block[:5] == b"HTTP/":
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[:end + 4], block[end + 4:]
    return b"", block


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """``YYYYMMDDhhmmss`` (or its first digits) as an ISO timestamp."""
    d = "".join(c for c in date if c.isdigit())[:14]
    d = d + "19700101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page: str, payload: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {date} {page} {hashlib.sha1(payload).hexdigest()}')}>"


def header(block: bytes, name: str) -> str | None:
    """Value of a header line, or None."""
    want = name.lower().encode()
    for line in block.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == want:
            return value.strip().decode("utf-8", "replace")
    return None


def warc_record(url: str, ip: str, date: str, http: bytes, payload: bytes, identity: str, refers_to: str | None, page: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only."""
    block = http if refers_to else http + payload
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {identity}",
        f"WARC-Date: {iso_date(date)}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}",
    ]
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    lines += [f"X-Page-Id: {page}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record of a WARC file (plain or gzip, one member or many)."""
    if content[:2] == b"\x1f\x8b":
        whole, rest = [], content
        while rest:
            d = zlib.decompressobj(31)
            whole.append(d.decompress(rest))
            rest = d.unused_data
        content = b"".join(whole)
    at = 0
    while True:
        at = content.find(b"WARC/", at)
        end = content.find(b"\r\n\r\n", at) if at >= 0 else -1
        if end < 0:
            return
        head = content[at:end]
        length = int(header(head, "Content-Length") or 0)
        yield head, content[end + 4:end + 4 + length]
        at = end + 4 + length


_RECORD = "page_id bigint, url string, ip string, date string, http binary, payload binary, digest string, record_id string"


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            out, held = [], 0
            for r in parse_arc(content.as_py() or b""):
                http, payload = split_http(r["block"])
                page = header(http, "X-Page-Id") or ""
                url, date = r.get("URL", ""), r.get("Archive-date", "")
                out.append((int(page) if page else None, url, r.get("IP-address", ""), date, http, payload,
                            hashlib.sha1(payload).hexdigest(), record_id(url, date, page, payload)))
                held += len(payload)
                if held > BATCH_BYTES or len(out) >= 256:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 3, pa.binary(), pa.binary(), pa.string(), pa.string()]
    names = [x.strip().split(" ")[0] for x in _RECORD.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def convert(arcs: DataFrame) -> DataFrame:
    """Records of ARC files. ``arcs`` has ``content``: the bytes of one file a row (null: none).

    Returns ``page_id`` (from the archived HTTP header, null if there is
    none), ``url, ip, date``, the HTTP header, the payload, its SHA-1 in hex,
    and the synthesised WARC identifier.
    """
    return arcs.select("content").mapInArrow(_convert, _RECORD)


def with_revisits(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """``records`` and ``refers_to_id``: the identifier of the response that a copy revisits.

    Of equal payloads of at least ``least`` bytes the one with the largest
    page_id is the response (so is each repetition of that very row). A null
    page_id is always a response that nothing refers to.
    """
    kept = (
        records.filter((F.length("payload") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first_"),
                               F.max(F.struct("page_id", "record_id")).alias("of"))
        .filter("first_ < last").select("digest", "last", F.col("of.record_id").alias("target"))
    )
    return records.join(kept, "digest", "left").withColumn(
        "refers_to_id", F.when((F.length("payload") >= least) & (F.col("page_id") < F.col("last")), F.col("target"))
    ).drop("last", "target")


def _serialise(file_bytes: int):
    """A task that writes records as text and numbers the files they go to, by bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = 0, 0
        for batch in batches:
            records, files = [], []
            for k in range(batch.num_rows):  # one at a time: a batch of large payloads is not held twice
                r = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
                record = warc_record(r["url"], r["ip"], r["date"], r["http"], r["payload"], r["record_id"], r["refers_to_id"],
                                     "" if r["page_id"] is None else str(r["page_id"]))[:-1]
                if held and held + len(record) > file_bytes:
                    file, held = file + 1, 0
                held += len(record) + 1
                records.append(record)
                files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(files, pa.int32())], names=["record", "file"])
    return run


def write_warc(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write records (see ``with_revisits``) as gzip WARC files below ``path``, each of bounded bytes and records.

    Spark's text writer appends the last line feed of every record, so the
    files are plain concatenations of records; its commit protocol covers
    retried tasks.
    """
    out = records.select("page_id", "url", "ip", "date", "http", "payload", "record_id", "refers_to_id")
    (out.mapInArrow(_serialise(file_bytes), "record binary, file int").select(F.col("record").cast("string"), "file")
     .write.partitionBy("file").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            out = []
            for head, block in parse_warc(content.as_py() or b""):
                http, payload = split_http(block)
                kind, page = header(head, "WARC-Type"), header(head, "X-Page-Id")
                digest = base64.b32decode((header(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")).hex()
                if kind == "response" and digest != hashlib.sha1(payload).hexdigest():
                    raise ValueError(f"payload of {header(head, 'WARC-Record-ID')} does not have its digest")
                size = len(payload) if kind == "response" else int(header(http, "Content-Length") or 0)
                out.append((int(page) if page else None, size, digest, kind, header(head, "WARC-Record-ID"), header(head, "WARC-Refers-To")))
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, record_id, refers_to_id`` of every record below ``path``.

    The payload of each response is held against its digest. The size of a
    revisit's payload is that in its HTTP header.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                                   "record_id string, refers_to_id string")


def _as_arc(version_of_row: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, version_of_row):
                version = 1 + (at // version_of_row) % 2
                part = [arc_head(version, f"pages-{at}.arc", date)]
                rows = batch.slice(at, version_of_row)
                for page, url, body in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                    payload = (body.as_py() or "").encode("utf-8", "surrogatepass")
                    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    http += f"Content-Length: {len(payload)}\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + "\r\n"
                    part.append(arc_record(version, url or "", "0.0.0.0", date, "text/html", http.encode() + payload))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(part)], pa.binary())], names=["content"])
    return run


def pages_as_arc(pages: DataFrame, per_file: int = 64, date: str = "20000101000000") -> DataFrame:
    """``content``: small ARC files of both versions that hold every row of ``pages`` (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        _as_arc(per_file, date), "content binary")


def page_archive(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` archived, converted, written as WARC and read back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    Null html is an empty payload, a null url is written as ``-``.
    """
    path = shared_path(pages.sparkSession, "warc")
    write_warc(with_revisits(convert(pages_as_arc(pages))), path)
    read = stored(read_warc(pages.sparkSession, path), "records")
    targets = read.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    wanted = read.filter("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    plain = read.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("bigint"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return wanted.select(cols).unionByName(plain.select(cols))


def op9_page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_archive(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""
