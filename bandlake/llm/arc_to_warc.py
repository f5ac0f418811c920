"""WARC: converter of legacy ARC archives.

Reads ARC files of version 1 (URL, IP address, date, content type, length) and version 2 (URL, IP address, date,
content type, result code, checksum, location, offset, file name, length), whose version block names the fields,
takes each document by its declared length, and writes the equivalent WARC/1.1 records: identifier, timestamp, type
and digests are synthesised. A payload that a smaller page has already becomes a revisit record.

Archives are rows (path, content), read from files by `arc_files` or written by `pages_to_arcs`; gzip members are expanded. A page's number travels in the
stored HTTP head (`X-Bandlake-Page-ID`), and records without one can be numbered by file and place.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.llm.components import to_be_deleted, written
from bandlake.session import shared_folder

FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
LEAST_REVISIT = 100
FILE_BYTES = 16 << 20
_PAGE = "X-Bandlake-Page-ID"
_IP, _DATE = rb"\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+|-", rb"\d{4,14}"
#: Header lines by version. The address and the date are found first, so URLs, content types and file names may hold blanks.
_LINES = {
    1: re.compile(rb"(.*) (%b) (%b) (.*) (\d+)\s*" % (_IP, _DATE)),
    2: re.compile(rb"(.*) (%b) (%b) (.*) (\d{1,3}|-) (\S+) (\S+) (\d+|-) (.*) (\d+)\s*" % (_IP, _DATE)),
}
_BLANK_LINE = re.compile(rb"\r?\n\r?\n")


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    document: bytes
    code: str = ""  # version 2 only


def page_urn(page_id: int | None, digest: bytes) -> str:
    """The record identifier of a page's payload, equal in every run."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"bandlake:{page_id}:{digest.hex()}").urn


def write_arc(records: list[ArcRecord], version: int, name: str = "legacy.arc") -> bytes:
    """An ARC file: its version block, then each document below its header line."""
    body = f"{version} 0 bandlake\n".encode() + FIELDS[version] + b"\n"
    out = [f"filedesc://{name} 0.0.0.0 19960923142103 text/plain {'' if version == 1 else f'200 - - 0 {name} '}{len(body)}\n".encode(), body, b"\n"]
    for r in records:
        extra = "" if version == 1 else f"{r.code or 200} - - 0 {name} "
        out += [f"{r.url} {r.ip} {r.date} {r.content_type} {extra}{len(r.document)}\n".encode(), r.document, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The documents of an ARC file of either version, plain or of gzip members. Raises ValueError where a line or a length is wrong."""
    if data.startswith(b"\x1f\x8b"):
        data = b"".join(_members(data))
    line_end = data.find(b"\n")
    if line_end < 0 or not data.startswith(b"filedesc://"):
        raise ValueError("no ARC version block")
    size = int(data[:line_end].rsplit(b" ", 1)[1])
    block = data[line_end + 1 : line_end + 1 + size].split(b"\n")
    version = int(block[0].split(b" ", 1)[0])
    if FIELDS.get(version) != block[1].strip():
        raise ValueError(f"fields of version {version} are not known: {block[1]!r}")
    at = line_end + 1 + size
    while True:
        while at < len(data) and data[at] in b"\r\n":
            at += 1
        if at >= len(data):
            return
        line_end = data.find(b"\n", at)
        line = data[at : line_end if line_end >= 0 else len(data)]
        found = _LINES[version].fullmatch(line) if line_end >= 0 else None
        if not found:
            raise ValueError(f"not an ARC header line: {line[:80]!r}")
        url, ip, date, kind, *more = (x.decode("utf-8", "replace") for x in found.groups())
        size = int(more[-1])
        if line_end + 1 + size > len(data):
            raise ValueError(f"the document of {url[:80]} is cut off")
        yield ArcRecord(url, ip, date, kind, data[line_end + 1 : line_end + 1 + size], more[0] if version == 2 else "")
        at = line_end + 1 + size


def _stamp(date: str) -> str:
    """An ARC date as a WARC timestamp; dates of fewer digits are filled up."""
    digits = "".join(x for x in date if x.isdigit())[:14]
    try:
        return datetime.strptime(digits + "00000101000000"[len(digits) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1996-01-01T00:00:00Z"


def split_http(document: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload), with line ends of either kind; a document without one is all payload."""
    if document.startswith(b"HTTP/") and (blank := _BLANK_LINE.search(document)):
        return document[: blank.end()], document[blank.end() :]
    return b"", document


def _number(text: bytes | str | None) -> int | None:
    """A page's number as it was written, None for anything else."""
    found = re.fullmatch(r"-?\d{1,19}", (text.decode("latin-1") if isinstance(text, bytes) else text or "").strip())
    return int(found[0]) if found and -(1 << 63) <= int(found[0]) < 1 << 63 else None


def _page_id(head: bytes) -> int | None:
    for line in head.split(b"\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == _PAGE.lower().encode():
            return _number(value)
    return None


def warc_record(r: ArcRecord, page_id: int | None, first: int | None = None) -> bytes:
    """The WARC record of an ARC document; with `first`, a revisit of that page's record, without payload."""
    head, payload = split_http(r.document)
    block = head if first is not None else r.document
    kind = "revisit" if first is not None else "response" if head else "resource"
    digest = hashlib.sha256(payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{page_urn(page_id, digest.digest())}>", f"WARC-Date: {_stamp(r.date)}", f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha256:{digest.hexdigest()}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {'application/http; msgtype=response' if head else r.content_type}", f"X-Payload-Length: {len(payload)}",
    ]
    if r.code:
        lines.append(f"X-ARC-Result-Code: {r.code}")
    if page_id is not None:
        lines.append(f"{_PAGE}: {page_id}")
    if first is not None:
        lines += [f"WARC-Refers-To: <{page_urn(first, digest.digest())}>", f"X-Refers-To-Page-ID: {first}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _members(data: bytes) -> Iterator[bytes]:
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data)
        data = z.unused_data


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of a WARC file of gzip members."""
    for raw in _members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        yield headers, rest[: int(headers["content-length"])]


def _clean_url(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 else c for c in url or "") or "urn:none"


def pages_to_arcs(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """Writes pages as ARC files of about FILE_BYTES / 4, of both versions in turn, below `folder` and returns them: path, content.

    A null html is an empty payload, a null url is urn:none, a null id is left out of the stored head. Other columns are not read.
    """

    def chunk(held: list[ArcRecord], name: str, seq: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_arc(held, 1 + seq % 2, name)], pa.binary())], ["path", "content"])

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        held: list[ArcRecord] = []
        for batch in stream:
            for i, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                own = "" if i is None else f"{_PAGE}: {i}\r\n"
                held.append(ArcRecord(_clean_url(u), "0.0.0.0", date, "text/html", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}\r\n".encode() + h.encode()))
                size += len(held[-1].document)
                if size >= FILE_BYTES // 4:
                    yield chunk(held, f"part-{part:05d}-{seq:05d}.arc", seq)
                    held, size, seq = [], 0, seq + 1
        if held:
            yield chunk(held, f"part-{part:05d}-{seq:05d}.arc", part + seq)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows.mapInArrow(task, "path string, content binary").write.mode("errorifexists").option("compression", "zstd").parquet(folder)
    return pages.sparkSession.read.schema("path string, content binary").parquet(folder)


def arc_files(spark: SparkSession, folder: str) -> DataFrame:
    """The .arc and .arc.gz files of a folder: path, content. Spark reads a file of up to 2 GiB into one row and stops at a larger one; archives are usually of 100 MB."""
    return spark.read.format("binaryFile").load(folder).where("lower(path) like '%.arc' or lower(path) like '%.arc.gz'").select("path", "content")


def read_arcs(archives: DataFrame, documents: bool = True, number: bool = False) -> DataFrame:
    """Every document of the archives: page_id, digest (of its payload, null below LEAST_REVISIT bytes) and, with documents, url, ip, date, content_type, code and document.

    page_id is the stored head's own, or null; with `number`, a document without one gets a hash of its file and place.
    """
    names = ["page_id", "digest"] + (["url", "ip", "date", "content_type", "code", "document"] if documents else [])
    types = [pa.int64(), pa.binary()] + ([pa.string()] * 5 + [pa.binary()] if documents else [])

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for place, r in enumerate(read_arc(content.as_py())):
                    head, payload = split_http(r.document)
                    own = _page_id(head)
                    if own is None and number:
                        own = int.from_bytes(hashlib.sha256(f"{path} {place}".encode()).digest()[:8], "big") >> 1
                    rows.append((own, hashlib.sha256(payload).digest() if len(payload) >= LEAST_REVISIT else None, *((r.url, r.ip, r.date, r.content_type, r.code, r.document) if documents else ())))
                    size += len(r.document) if documents else 64
                    if size >= FILE_BYTES // 16:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.mapInArrow(task, ", ".join(f"{n} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in zip(names, types, strict=True)))


def convert_archives(archives: DataFrame, number: bool = False) -> DataFrame:
    """ARC files (path, content) converted to WARC records: page_id, record (gzip member), one per document.

    Of equal payloads of at least LEAST_REVISIT bytes, the page with the smallest id is the response and others revisit it. Documents of that
    id and payload are all responses. Documents without an id come after those with one; where none has an id, all are responses.
    """
    seen = read_arcs(archives, documents=False, number=number).where("digest is not null")
    sizes = written(seen.groupBy("page_id", "digest").agg(F.count("*").alias("n")), "payload-pages")
    copies = written(sizes.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "payloads")
    # payloads of over a thousandth of the pages, a thousand at most, are broadcast; the others' pages are few each
    often = sizes.count() // 1000
    found = sizes.drop("n").join(F.broadcast(copies.where(F.col("n") > often).select("digest", F.col("first").alias("often"))), "digest", "left")
    rest = found.where("often is null").drop("often").join(copies.where(F.col("n") <= often).select("digest", "first"), "digest")
    few = found.where("often is not null").withColumnRenamed("often", "first").select("digest", "page_id", "first").unionByName(rest).where("not (page_id <=> first)")
    few = written(few, "revisits").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    records = read_arcs(archives, number=number)
    marked = records.join(few, records["page_id"].eqNullSafe(few["p"]) & (records["digest"] == few["d"]), "left").drop("p", "d", "digest")

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                records = [gzip_member(warc_record(ArcRecord(r["url"], r["ip"], r["date"], r["content_type"], r["document"], r["code"]), r["page_id"], r["first"])) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(records, pa.binary())], ["page_id", "record"])

    return marked.mapInArrow(task, "page_id long, record binary")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records as .warc.gz files of about FILE_BYTES below `folder` and returns their paths and sizes.

    Spark writes the members to a table of chunks first; each chunk is a complete archive of whole records, so
    any Spark reader and any file system that Spark can write to will do."""

    def chunks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, seq = TaskContext.get().partitionId(), [], 0, 0
        for batch in stream:
            for x in batch.column("record"):
                held.append(x.as_py())
                size += len(held[-1])
                if size >= FILE_BYTES // 4:
                    yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{seq:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["path", "content"])
                    held, size, seq = [], 0, seq + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{seq:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["path", "content"])

    records.mapInArrow(chunks, "path string, content binary").write.mode("errorifexists").option("compression", "none").parquet(folder)
    return records.sparkSession.read.schema("path string, content binary").parquet(folder)


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, url, date, record_type, payload_bytes, payload_digest, refers_to and, where a record has one, its payload's
    digest computed anew (`stored_digest`)."""

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for content in batch.column("content"):
                rows = []
                for h, block in read_warc(content.as_py()):
                    payload = split_http(block)[1] if h["warc-type"] == "response" else None
                    rows.append((
                        _number(h.get(_PAGE.lower())), h["warc-target-uri"], h["warc-date"], h["warc-type"], len(payload) if payload is not None else int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:"),
                        _number(h.get("x-refers-to-page-id")), hashlib.sha256(payload).hexdigest() if payload is not None else None,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return archives.mapInArrow(task, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(_NAMES, _TYPES, strict=True)))


_NAMES = ["page_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to", "stored_digest"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]


def arc_round_trip(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """Writes pages as ARC files to the shared folder, converts these, writes the WARC archives and reads them back."""
    folder = to_be_deleted(f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}")
    arcs = pages_to_arcs(pages, f"{folder}/arc", **columns)
    return read_archives(write_archives(convert_archives(arcs), f"{folder}/warc"))
