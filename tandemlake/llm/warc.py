"""WARC archives and their revisit resolution.

Pages are written as gzip-per-record archives, a file for each task and FILE_BYTES, and a header table tells where each
record lies. Only headers are shuffled: by payload digest, to find the original response of each payload, and back to their
archive files. Each archive is then rewritten by itself: responses keep their payload, the others become revisit records
that name the original; every record has fresh headers. Files are named anew in each attempt and only those that the header
table names count, so a task that is run again leaves no half-written archive behind that would be read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored, tidy

FILE_BYTES = 32_000_000
PIECE = 16_384
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "file string, offset long, size long, page_id long, url string, digest string, payload_bytes long, type string, refers_to long, refers_to_url string"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_bytes(kind: str, page_id: int | None, url: str | None, digest: str, payload_bytes: int, payload: bytes, refers_to: int | None = None, refers_to_url: str | None = None) -> bytes:
    """One record, as a gzip member. The SHA-1 of the full payload stands in base 16."""
    block = HTTP + payload if kind == "response" else HTTP
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Payload-Length: {payload_bytes}",
    ]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_line(refers_to_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _line(url: str | None) -> str:
    """A url on one line: control characters and blanks are percent-encoded, a null one is empty."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """The records of an archive: offset, size, headers, block."""
    at = 0
    while at < len(data):
        unpacker, parts, to = zlib.decompressobj(31), [], at
        while not unpacker.eof and to < len(data):
            parts.append(unpacker.decompress(data[to : to + PIECE]))
            to += PIECE
        raw, size = b"".join(parts), min(to, len(data)) - at - len(unpacker.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1" or not unpacker.eof:
            raise ValueError(f"no WARC record at offset {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        n = int(fields["Content-Length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"record at offset {at} has a wrong length")
        yield at, size, fields, rest[:n]
        at += size


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


class Archives:
    """Archive files under a folder, by any file system that pyarrow opens."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.folder = folder
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.out, self.name, self.offset = None, "", 0

    def write(self, record: bytes) -> tuple[str, int, int]:
        if self.out is None or self.offset + len(record) > FILE_BYTES and self.offset:
            self.close()
            self.name, self.offset = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.out.write(record)
        place = self.name, self.offset, len(record)
        self.offset += len(record)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def read(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return f.read()

    def read_at(self, name: str, places: list[tuple[int, int]]) -> Iterator[bytes]:
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            for offset, size in places:
                f.seek(offset)
                yield f.read(size)


def _headers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = ["file", "offset", "size", "page_id", "url", "digest", "payload_bytes", "type", "refers_to", "refers_to_url"]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """A response record for each row of pages (page_id, url, html) -> the header table. A null html is an empty payload."""
    small_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives(folder)
        for b in batches:
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in b.columns)):
                payload = html or b""
                digest = hashlib.sha1(payload).hexdigest()
                place = archives.write(record_bytes("response", page, url, digest, len(payload), payload))
                rows.append((*place, page, url, digest, len(payload), "response", None, None))
            yield _headers(rows)
        archives.close()

    return stored(pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(tidy(work), HEADERS), "warc-headers")


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Headers with type and refers_to decided: of equal payloads of least_bytes or more, the largest page_id (null counts as least;
    of equal ones that with the largest hash of its place) is response and the others revisit it; smaller payloads are all response.

    The original of each digest is a partial aggregate, so a payload that a third of all pages have meets nowhere.
    """
    mine = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), F.xxhash64("file", "offset").alias("tie"), F.col("file").alias("f"), F.col("offset").alias("o"), F.col("url").alias("u"), F.col("page_id").alias("p"))
    originals = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(F.max(mine).alias("original"), F.count("*").alias("times")).where("times > 1")
    joined = headers.join(originals.drop("times"), ["digest", "payload_bytes"], "left")
    again = F.coalesce((F.col("original.f") != F.col("file")) | (F.col("original.o") != F.col("offset")), F.lit(False))
    return joined.select(
        "file", "offset", "size", "page_id", "url", "digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("type"),
        F.when(again, F.col("original.p")).alias("refers_to"),
        F.when(again, F.col("original.u")).alias("refers_to_url"),
    )


def rewrite(decided: DataFrame, source: str, target: str) -> DataFrame:
    """Write deduplicated archives: each source file is read at the places of its records, in order -> the new header table.

    Archives are at most FILE_BYTES (or one record) long, which bounds what a task gathers for one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = Archives(source), Archives(target)
        for b in batches:
            out: list[tuple] = []
            rows = b.to_pylist()
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j]["file"] == rows[i]["file"]:
                    j += 1
                part = rows[i:j]
                keep = iter(old.read_at(part[0]["file"], [(r["offset"], r["size"]) for r in part if r["type"] == "response"]))
                for r in part:
                    payload = payload_of(next(parse_records(next(keep)))[3]) if r["type"] == "response" else b""
                    place = new.write(record_bytes(r["type"], r["page_id"], r["url"], r["digest"], r["payload_bytes"], payload, r["refers_to"], r["refers_to_url"]))
                    out.append((*place, r["page_id"], r["url"], r["digest"], r["payload_bytes"], r["type"], r["refers_to"], r["refers_to_url"]))
                i = j
            yield _headers(out)
        new.close()

    return stored(decided.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(tidy(work), HEADERS), "warc-new-headers")


def read_archives(headers: DataFrame, folder: str) -> DataFrame:
    """What the archives named in headers say, record by record; payloads of responses are digested again and compared."""
    files = headers.select("file").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for offset, size, head, block in parse_records(archives.read(name)):
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (hashlib.sha1(payload := payload_of(block)).hexdigest() != digest or len(payload) != n):
                        raise ValueError(f"{name}: the payload at {offset} isn't the one in the header")
                    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                    rows.append((name, offset, size, page and int(page), head["WARC-Target-URI"], digest, n, head["WARC-Type"], int(refers) if refers not in (None, "None") else None, head.get("WARC-Refers-To-Target-URI")))
                yield _headers(rows)

    return files.repartition("file").mapInArrow(tidy(work), HEADERS)


def deduplicate(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Archives of pages, deduplicated -> (what is read back from them, the folder they are in).

    A row for each row of pages: null urls are empty, null htmls empty payloads, repeated rows are records of their own.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    headers = write_archives(pages, f"{folder}/original")
    new = rewrite(resolve(headers), f"{folder}/original", f"{folder}/deduplicated")
    return read_archives(new, f"{folder}/deduplicated"), f"{folder}/deduplicated"
