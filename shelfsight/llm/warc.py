"""WARC archives: writing, a normaliser for whole-file gzip streams, and reading back by offset.

``write`` gives each task's records to archives that are one gzip stream each, as crawlers often leave them. ``normalise``
inflates such a stream once, rewrites every record as a gzip member of its own and writes a sidecar index with a line for each
record (offset, length, type, record id). ``read`` takes the records of normalised archives by their offsets.

Archives lie in a folder that all executors reach. A task that is run again writes files of new names; only files that a
finished task has named are used. Records stream through: a task holds one record and a buffer.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest page id is the response and the
others revisit it; smaller ones are all responses.

Defined results: a null html is the empty payload, a null url gives no target; rows that repeat the smallest id of their payload
are responses all; a null id is never the smallest, and where all ids of a payload are null they are responses; an empty
table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_folder

LEVEL = 3
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Schemes of Hadoop's file systems, and the names that Arrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "hdfs": "hdfs", "viewfs": "viewfs", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
FILES = "path string, index string, records long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", json.dumps(url, ensure_ascii=False) if url != url.strip() or any(c < " " or c == '"' for c in url) else url))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Inflated:
    """Bytes of a gzip file of one or more members, read in order."""

    def __init__(self, stream) -> None:
        self.stream, self.inflate, self.held, self.at = stream, zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        chunk = rest or self.stream.read(CHUNK)
        if self.inflate.eof and chunk:
            self.inflate = zlib.decompressobj(31)
        if not chunk:
            if not self.inflate.eof:
                raise ValueError("the archive ends inside its gzip stream")
            return False
        self.held = self.held[self.at :] + self.inflate.decompress(chunk, CHUNK)
        self.at = 0
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``; b"" at the end of the file."""
        tried = 0
        while True:
            found = self.held.find(mark, self.at + tried)
            if found >= 0:
                out, self.at = self.held[self.at : found + len(mark)], found + len(mark)
                return out
            tried = max(0, len(self.held) - self.at - len(mark))
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError("the archive ends inside a record's header")
                return b""

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the archive ends inside a record")
            piece = self.held[self.at : self.at + size]
            self.at += len(piece)
            size -= len(piece)
            yield piece


def header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:] if line)}


def arrow_uri(uri: str) -> str:
    """A folder as Hadoop names it, under the scheme that Arrow has for its file system."""
    scheme, mark, rest = uri.partition(":")
    if not mark or "/" in scheme:
        return uri
    if scheme == "file":
        return "/" + rest.lstrip("/")
    if scheme not in SCHEMES:
        raise ValueError(f"archives can't be written to {scheme}: of {uri}; known are {', '.join(sorted(SCHEMES))} and file")
    return f"{SCHEMES[scheme]}:{rest}"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there.

    Credentials and endpoints come from the environment of the executors (AWS_*, AZURE_*, a Hadoop client for hdfs).
    """
    return fs.FileSystem.from_uri(arrow_uri(uri))


def _digest(html: Column) -> Column:
    return F.sha1(F.coalesce(html.cast("string"), F.lit("")).cast("binary"))


def decisions(pages: DataFrame, page_id: str, html: str, least_bytes: int) -> DataFrame:
    """(page, digest, first): a row for each page and payload that revisits, with the id of its response."""
    size = F.octet_length(F.coalesce(F.col(html).cast("string"), F.lit("")))
    drawn = pages.select(F.col(page_id).cast("long").alias("page"), _digest(F.col(html)).alias("digest"), size.alias("n")).where(F.col("n") >= least_bytes)
    drawn = saved(drawn.select("page", "digest"), "payloads")
    heads = drawn.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    revisits = drawn.join(heads, "digest").where("not (page <=> first)")
    return saved(revisits.groupBy("page", "digest").agg(F.first("first").alias("first")), "revisits")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes each page as a record of an archive that is a single gzip stream; returns the files."""
    told = decisions(pages, page_id, html, least_bytes)
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), _digest(F.col(html)).alias("own_digest"))
    # By page and payload, so that a null or repeated id meets its own response only and spreads by its payloads.
    rows = own.join(told, own["page_id"].eqNullSafe(told["page"]) & (own["own_digest"] == told["digest"]), "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(folder)
        stream, path, held, count, files = None, "", 0, 0, []

        def close() -> None:
            stream.write(packer.flush())
            stream.close()
            files.append((path, count))

        for batch in batches:
            for k in range(batch.num_rows):
                page, target, text, first = (batch.column(c)[k].as_py() for c in range(4))
                payload = (text or "").encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                if stream is None:
                    system.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    stream, packer, held, count = system.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                stream.write(packer.compress(record(page, target, payload, digest, first, first is not None, date)))
                held, count = held + len(payload), count + 1
                if held >= archive_bytes:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield _file_rows([(p, None, n) for p, n in files])

    return saved(rows.mapInArrow(run, FILES), "archives")


def _file_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["path", "index", "records"])


def _each_file(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives with a gzip member for each record and a sidecar index; returns the new files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path = f"{base}/{uuid.uuid4().hex}.member.warc.gz"
                records = offset = 0
                with system.open_input_stream(source, compression=None) as taken, system.open_output_stream(path, compression=None) as given, system.open_output_stream(f"{path}.idx", compression=None) as index:
                    inflated = Inflated(taken)
                    while head := inflated.until(b"\r\n\r\n"):
                        fields = header(head)
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        length = given.write(packer.compress(head))
                        for piece in inflated.pieces(int(fields["content-length"]) + 4):
                            length += given.write(packer.compress(piece))
                        length += given.write(packer.flush())
                        index.write(f"{offset} {length} {fields['warc-type']} {fields['warc-record-id']}\n".encode())
                        offset, records = offset + length, records + 1
                yield _file_rows([(path, f"{path}.idx", records)])

    return saved(_each_file(files).mapInArrow(run, FILES), "normalised")


def _parsed(member: bytes, payloads: bool) -> tuple:
    raw = zlib.decompress(member, 31)
    cut = raw.index(b"\r\n\r\n") + 4
    fields = header(raw[:cut])
    block = raw[cut : cut + int(fields["content-length"])]
    http = block.index(b"\r\n\r\n") + 4
    size = int(header(block[:http])["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    payload = None if revisit else block[http:]
    if payload is not None and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload isn't the one that its digest names")
    url = fields.get("warc-target-uri")
    whole = lambda name: int(fields[name]) if name in fields else None
    return (
        whole("x-page-id"), json.loads(url) if url and url[0] == '"' else url, fields["warc-type"], size, digest, whole("x-refers-to-page-id"), payload if payloads else None,
    )


def read(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of normalised archives, taken by the offsets of their index; response payloads are checked by digest."""
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = store(folder)
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(index, compression=None) as lines:
                    places = [tuple(map(int, line.split()[:2])) for line in lines.read().splitlines()]
                with system.open_input_file(path) as archive:
                    rows, held = [], 0
                    for k, (offset, length) in enumerate(places):
                        archive.seek(offset)
                        rows.append(_parsed(archive.read(length), payloads))
                        held += rows[-1][3] if payloads else 0
                        if k + 1 == len(places) or len(rows) >= 4096 or held >= (16 << 20):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0

    return _each_file(files).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Pages written as archives in the shared folder, normalised and read back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read(normalise(write(pages, folder, page_id, url, html, least_bytes), folder), folder, payloads)
