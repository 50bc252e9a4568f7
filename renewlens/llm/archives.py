"""Legacy ARC archives and their conversion to WARC records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a record's header line by version of the archive (fixed by the format).
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
#: Time of capture written for pages that carry none.
CAPTURED = "20240101000000"
#: Records of one slice of an archive, each slice with a version block of its own.
SLICE = 500
#: Compression of the archives that are written. Level 4 took a third of the CPU time of the default, 6, on HTML
#: and made the files 4 % larger.
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR"}
_PAGE = "X-Page-Id"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _version_block(version: int) -> str:
    body = f"{version} 0 pages\n{' '.join(FIELDS[version])}\n"
    head = {"url": "filedesc://pages.arc", "ip": "0.0.0.0", "date": CAPTURED, "type": "text/plain", "code": "200",
            "length": str(len(body))}
    return " ".join(head.get(f, "-") for f in FIELDS[version]) + "\n" + body


def arc_records(pages: DataFrame) -> DataFrame:
    """(value): the text of ARC archives of (page_id, url, html), version blocks included.

    Half of the tasks write version 1, half version 2. The page id travels as a header of the HTTP
    response; a null html has an empty payload, a null url is written as ``unknown:``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, n = 1 + TaskContext.get().partitionId() % 2, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, rows = batch.slice(at, SLICE), [_version_block(version)]
                for page, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    html = html or ""
                    size = len(html.encode())
                    block = (
                        f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n"
                        f"{_PAGE}: {'' if page is None else page}\r\n\r\n"
                    )
                    head = {
                        "url": quote(url or "unknown:", safe=":/?#[]@!$&'()*+,;=%~-._"), "ip": "0.0.0.0", "date": CAPTURED,
                        "type": "text/html", "code": "200", "offset": str(n), "filename": "pages.arc",
                        "length": str(len(block) + size),
                    }
                    n += 1
                    rows.append(" ".join(head.get(f, "-") for f in FIELDS[version]) + "\n" + block + html)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "value string")


def write_arc(pages: DataFrame, path: str) -> None:
    """Write pages as gzipped ARC archives, one file per task, by Spark's text writer."""
    arc_records(pages).write.options(**GZIP).option("lineSep", "\n").text(path)


def _open(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def _arc_entries(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record, version blocks left out.

    A version block says which fields follow. A header of ten fields with a date in its place is one of
    version 2 anywhere; without a version block all others are of version 1.
    """
    with _open(content) as stream:
        fields = None
        while line := stream.readline():
            parts = line.decode("utf-8", "replace").split()
            if not parts:
                continue
            if len(parts) == len(FIELDS[2]) and parts[2].isdigit():
                names = FIELDS[2]
            else:
                names = fields if fields and len(parts) >= len(fields) else FIELDS[1]
            # blanks in front belong to the address
            parts = line.decode("utf-8", "replace").strip().rsplit(None, len(names) - 1)
            if len(parts) != len(names) or not parts[-1].isdigit():
                raise ValueError(f"not an ARC header: {line[:200]!r}")
            head = dict(zip(names, parts))
            block = stream.read(int(head["length"]))
            if len(block) != int(head["length"]):
                raise ValueError(f"archive ends inside {head['url']}")
            if head["url"].startswith("filedesc:"):
                version = block.split(None, 1)[:1]
                fields = FIELDS.get(int(version[0])) if version and version[0].isdigit() else None
                continue
            yield head, block


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    if not ends:
        return block, b""
    at, mark = min(ends)
    return block[:at + len(mark)], block[at + len(mark):]


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, date, type, http, payload, digest, size) of the records of ARC archives."""
    schema = "page_id long, url string, date string, type string, http binary, payload binary, digest string, size long"
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.int64())
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(content: bytes) -> Iterator[tuple]:
        for head, block in _arc_entries(content):
            http, payload = _split_http(block)
            page = next((x.partition(b":")[2].strip() for x in http.splitlines() if x.startswith(_PAGE.encode())), b"")
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            yield (int(page) if page else None, head["url"], head["date"], head["type"], http, payload, digest, len(payload))

    return _files(spark, path).mapInArrow(_each_file(rows, names, kinds), schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _each_file(rows, names, kinds):
    """Batches of about 8 MB from the records of whole files, one file in memory at a time."""

    def pack(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, size = [], 0
                for row in rows(batch.column(0)[i].as_py()):
                    part.append(row)
                    size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
                    if size > 8 << 20:
                        yield pack(part)
                        part, size = [], 0
                if part:
                    yield pack(part)

    return run


def warc_records(entries: DataFrame) -> DataFrame:
    """(value): a WARC record for every ARC entry.

    Of entries with equal payloads the one with the largest page_id is a response, the others are
    revisits of it without payload, those without page_id too. If none of them has a page_id, all are
    responses. Identifiers are name-based on page and digest, so a rerun writes the same; without page_id
    the place among the entries stands for it.
    """
    newest = entries.groupBy("digest", "size").agg(F.max("page_id").alias("newest"))
    joined = entries.join(newest, ["digest", "size"])
    slim = joined.select(
        "page_id", "url", "date", "type", "http", "digest", "size", "newest",
        F.when(F.col("page_id").eqNullSafe(F.col("newest")), F.col("payload")).alias("payload"),
        F.monotonically_increasing_id().alias("place"),
    )

    def record(page, url, date, kind, http, digest, size, newest, payload, place) -> str:
        name = lambda p: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{p} {digest}')}>"
        revisit = payload is None
        block, coding = http + (payload or b""), None
        try:
            body = block.decode()
        except UnicodeDecodeError:  # Spark's text writer takes UTF-8 only
            body, coding = base64.b64encode(block).decode(), "base64"
        day = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
        head = [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", name(f"place {place}" if page is None else page)), ("WARC-Date", day), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
            ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" if revisit else None),
            ("WARC-Refers-To", name(newest) if revisit else None),
            ("WARC-X-Refers-To-Page", newest if revisit else None),
            ("WARC-X-Page", page), ("WARC-X-Payload-Length", size), ("WARC-X-Block-Coding", coding),
            ("Content-Type", "application/http; msgtype=response" if http else kind),
            ("Content-Length", len(body.encode())),
        ]
        return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n" + body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                columns = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([record(*row) for row in zip(*columns)], pa.string())], names=["value"]
                )

    return slim.mapInArrow(run, "value string")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert ARC archives to gzipped WARC archives, one file per task."""
    records = warc_records(read_arc(spark, arc_path))
    records.write.options(**GZIP).option("lineSep", "\r\n\r\n").text(warc_path)


def _warc_entries(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    with _open(content) as stream:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:200]!r}")
            head = {}
            while (line := stream.readline()).strip():
                key, _, value = line.decode().partition(":")
                head[key.strip().lower()] = value.strip()
            size = int(head["content-length"])
            block = stream.read(size)
            if len(block) != size:
                raise ValueError("archive ends inside a record")
            yield head, base64.b64decode(block) if head.get("warc-x-block-coding") == "base64" else block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date, payload).

    The payload of a response is held against its length and digest.
    """
    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, url string, date string, payload binary"
    )
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
    names = [x.split()[0] for x in schema.split(", ")]
    number = lambda x: None if x is None else int(x)

    def rows(content: bytes) -> Iterator[tuple]:
        for head, block in _warc_entries(content):
            digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
            size, payload = int(head["warc-x-payload-length"]), None
            if kind == "response":
                payload = _split_http(block)[1]
                if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {head['warc-record-id']} is damaged")
            yield (
                number(head.get("warc-x-page")), size, digest, kind, number(head.get("warc-x-refers-to-page")),
                head["warc-record-id"], head["warc-target-uri"], head["warc-date"], payload,
            )

    return _files(spark, path).mapInArrow(_each_file(rows, names, kinds), schema)
