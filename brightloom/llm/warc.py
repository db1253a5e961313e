"""WARC archives: one gzip member per record, written by tasks and read back by byte ranges.

A reading task gets a range of a file. It looks for gzip's magic bytes, takes a candidate for
a record only if a WARC header decodes there and the member ends with the right checksum, and
owns the records that start inside its range, however far they reach beyond it.

Missing html is an empty payload. Pages without a page_id are always responses; rows that
repeat the page_id of a response are responses as well. An empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.files import NewFile, open_random
from brightloom.session import cut_lineage, fresh_path

# The formats' own marks
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

DATE = "2000-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 100
FILE_BYTES, SPLIT_BYTES, READ_BYTES = 1 << 28, 1 << 22, 1 << 18
MANIFEST = "file string, bytes long, records long"
RECORD = (
    "file string, offset long, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add payload, digest, size and ``first_id``: the smallest page_id with the same payload, if long enough."""
    p = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "coalesce(html, '') AS payload").selectExpr(
        "*", "sha2(payload, 256) AS digest", "CAST(octet_length(payload) AS BIGINT) AS n_bytes"
    )
    # stored, so that the join has an exchange of its own, whose large partitions Spark can split
    shared = cut_lineage(
        p.filter(F.col("n_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("_copies"))
        .filter("_copies > 1")
        .drop("_copies")
    )
    return p.join(shared, "digest", "left")


def _record(page_id, url, payload: bytes, digest: str, first_id) -> bytes:
    revisit = page_id is not None and first_id is not None and page_id != first_id
    http = HTTP_HEAD.format(len(payload)).encode()
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{first_id}>"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and return their committed manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, records = None, 0

        def close() -> pa.RecordBatch:
            out.close()
            row = [[out.path], [out.offset], [records]]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in row], names=["file", "bytes", "records"])

        for b in batches:
            columns = [b.column(i) for i in range(5)]
            for i in range(len(b)):
                page_id, url, payload, digest, first_id = (c[i].as_py() for c in columns)
                if out is None:
                    out, records = NewFile(f"{folder}/archives", ".warc.gz"), 0
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(gz.compress(_record(page_id, url, payload.encode(), digest, first_id)) + gz.flush())
                records += 1
                if out.offset >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = mark_revisits(pages, min_bytes).select("page_id", "url", "payload", "digest", "first_id")
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(pages.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Source:
    """A file with one kept block, so that scanning reads each byte about once."""

    def __init__(self, file):
        self.file, self.size, self.at, self.block = file, file.size(), 0, b""

    def get(self, offset: int) -> bytes:
        """Some bytes from ``offset`` on; none at the end of the file."""
        if not self.at <= offset < self.at + len(self.block):
            self.at, self.block = offset, self.file.read_at(min(READ_BYTES, max(0, self.size - offset)), offset)
        return self.block[offset - self.at :]


def next_magic(src: _Source, at: int, end: int) -> int:
    """First place in [at, end) where gzip's magic bytes start, else -1."""
    while at < end:
        block = src.get(at)
        if len(block) < len(GZIP_MAGIC):  # the magic may cross from one block into the next
            block = src.file.read_at(min(READ_BYTES, src.size - at), at)
            if len(block) < len(GZIP_MAGIC):
                return -1
            src.at, src.block = at, block
        hit = block.find(GZIP_MAGIC)
        if hit >= 0:
            return at + hit if at + hit < end else -1
        at += len(block) - len(GZIP_MAGIC) + 1
    return -1


def read_member(src: _Source, at: int) -> tuple[bytes, int] | None:
    """The record of the gzip member that starts at ``at`` and where it ends; None if there is none."""
    gz, parts, seen, offset = zlib.decompressobj(31), [], b"", at
    try:
        while not gz.eof:
            block = src.get(offset)
            if not block:
                return None
            data = gz.decompress(block)
            parts.append(data)
            if len(seen) < len(VERSION):
                seen += data[: len(VERSION) - len(seen)]
                if not VERSION.startswith(seen):
                    return None  # a gzip member or chance bytes, but no record
            offset += len(block) - len(gz.unused_data)
    except zlib.error:
        return None
    return (b"".join(parts), offset) if seen == VERSION else None


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    head, found, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    size = fields.get("Content-Length", "")
    if not found or not size.isdigit() or len(block) < int(size):
        return None
    return fields, block[: int(size)]


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records that start in [start, end)."""
    src, at = _Source(file), start
    while 0 <= (at := next_magic(src, at, end)):
        member = read_member(src, at)
        record = parse_record(member[0]) if member else None
        if record is None:
            at += 1
            continue
        yield at, *record
        at = member[1]


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives that a manifest names (``RECORD``); files are read in splits."""
    splits = manifest.selectExpr("file", "bytes", f"explode(sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)) AS start")
    splits = splits.selectExpr("file", "start", f"least(start + {split_bytes}L, bytes) AS end")
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, end in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows, held = [], 0
                with open_random(name) as file:
                    for at, fields, block in records_in(file, start, end):
                        kind = fields.get("WARC-Type")
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                        else:
                            payload, size = None, int(fields.get("X-Payload-Length", 0))
                            digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                        rows.append((
                            name, at, fields.get("WARC-Record-ID"), kind, fields.get("WARC-Target-URI"),
                            fields.get("WARC-Refers-To"), digest, size, payload if with_payload else None,
                        ))
                        held += len(block) if with_payload else 200
                        if held > 1 << 22:
                            yield _batch(rows, kinds, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds, names)

    # a number of its own, as the rows are few and the work behind each is large
    tasks = manifest.selectExpr(f"coalesce(sum(ceil(bytes / {split_bytes})), 0)").first()[0]
    return splits.repartition(max(1, int(tasks)), "file", "start").mapInArrow(read, RECORD)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and describe what is read back, per page."""
    folder = fresh_path(pages.sparkSession, "warc")
    records = read_archives(write_archives(pages, folder), with_payload=False)
    page = "CAST(nullif(regexp_extract({}, '^<urn:page:(-?[0-9]*)>$', 1), '') AS BIGINT)"
    return records.selectExpr(
        page.format("record_id") + " AS page_id", "payload_bytes", "payload_digest", "record_type",
        page.format("refers_to") + " AS refers_to",
    )
