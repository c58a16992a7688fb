"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

Writer. Payload digests are grouped (partial aggregation, so a payload that a third of the pages share costs one row
per task); each page then learns whether it is its payload's response or revisits the response of the least page_id.
Records are gzip members, written by Spark's own text writer, whose commit survives lost tasks: a member ends with the
high byte of its length, which is NUL for records under 16 MiB (an empty member follows a longer one), and that NUL is
the writer's line separator, so the files are plain concatenated members.

Reader. A task gets a byte range of a file. It scans for the gzip magic, accepts a candidate if the bytes after it
inflate to a WARC version line, and owns the records that start in its range, reading past the range's end to finish
the last one. After a record the next member starts at once, so scanning is needed only at the range's start or after
damage, which ends with the next valid member. Payloads are UTF-8, which cannot hold the magic, so a stored (not
deflated) payload can't be mistaken for a member.

Defined results: null html is the empty payload; null url is left out; among repeated rows of one page_id and payload
one is the response and the rest revisit it; null page_ids sort before all others; further columns are ignored; an
empty table makes no archive and reads back as no rows.

Memory: a task holds one record and READ_BYTES of a file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import scratch, ship

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
READ_BYTES, SPLIT_BYTES, PROBE = 1 << 20, 8 << 20, 4096
#: With more ranges than this a task reads several.
MOST_TASKS = 100_000
#: 1970, as records must not differ between runs.
DATE = "1970-01-01T00:00:00Z"


def decisions(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, first) of the pages whose payload occurs more than once; first: the response's page_id."""
    sizes = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size"))
    rows = sizes.groupBy("page_id", "digest", "size").agg(F.count(F.lit(1)).alias("copies"))
    group = rows.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id")).alias("least"), F.sum("copies").alias("n"))
    many = group.where("n > 1").select("digest", F.col("least.page_id").alias("first"))
    return rows.where(F.col("size") >= least_bytes).join(many, "digest").select("page_id", "digest", "first")


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member without its last byte, which is NUL."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {''.join(c for c in url if c >= ' ')}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    block = b"" if is_revisit else payload
    head += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(block)}"]
    out = gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)
    if out[-1]:
        out += gzip.compress(b"", 6, mtime=0)
    return out[:-1]


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per row (page_id, url, html) as gzip members under path."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    known = decisions(rows, least_bytes).select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), "first", F.lit(True).alias("shared"))

    def deflate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([zlib.compress(h.encode(), 6) for h in part.column(2).to_pylist()], pa.binary()), part.column(3)], ["page_id", "url", "html", "digest"])

    # Payloads are shuffled deflated.
    small = rows.withColumn("digest", F.sha1("html")).mapInArrow(deflate, "page_id long, url string, html binary, digest string")
    joined = small.join(known.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")
    # Repeats of one page_id and payload: all but one revisit it.
    copy = F.row_number().over(W.partitionBy("page_id", "digest").orderBy("url"))
    chosen = joined.select("page_id", "url", "html", "first", F.coalesce("shared", F.lit(False)).alias("shared"), copy.alias("copy"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for page_id, url, html, first, shared, copy_no in zip(*(c.to_pylist() for c in part.columns), strict=True):
                payload = zlib.decompress(html)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.append(member(page_id, url, payload, digest, first, shared and (first != page_id or copy_no > 1)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = chosen.select("page_id", "url", "html", "first", "shared", "copy").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def open_input(uri: str):
    """A seekable file: local and mounted paths directly, other stores through Arrow."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


class Window:
    """Bytes of a file around a moving position."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(n, READ_BYTES))
        return self.data[at - self.start : at - self.start + n]

    def find(self, at: int, end: int) -> int:
        """First place of the magic that starts in [at, end), or -1."""
        while at < end:
            data = self.get(at, min(READ_BYTES, self.size - at))
            i = data.find(MAGIC)
            if i >= 0:
                return at + i if at + i < end else -1
            at += max(1, len(data) - len(MAGIC) + 1)
        return -1


def inflate(window: Window, at: int, most: int | None = None) -> tuple[bytes, int] | None:
    """(content, place after the member) of the member at a place; with most, only so many bytes of content."""
    z, out, place = zlib.decompressobj(31), [], at
    try:
        while place < window.size and not z.eof:
            data = window.get(place, min(PROBE if most else 1 << 16, window.size - place))
            out.append(z.decompress(data, most or 0))
            place += len(data)
            if most:
                return b"".join(out), place
    except zlib.error:
        return None
    return (b"".join(out), place - len(z.unused_data)) if z.eof else None


def members(uri: str, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end)."""
    with open_input(uri) as file:
        window, at = Window(file, size), start
        while (at := window.find(at, end)) >= 0:
            probe = inflate(window, at, 64)
            found = inflate(window, at) if probe is not None and probe[0].startswith(VERSION) else None
            if found is None:
                at += 1
                continue
            yield at, found[0]
            at = found[1]


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields.get("content-length", len(rest)))]


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives under path: file, at, headers' values, and what the payload itself gives."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start"))
    # Told by bytes of the archives: the rows that name ranges are too small for adaptive execution to see what they cost.
    total = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    spans = ranges.repartition(min(int(total), MOST_TASKS))
    names = ["file", "at", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "intact", *["payload"] * with_payload]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def number(urn: str | None) -> int | None:
        digits = (urn or "").rpartition(":")[2].rstrip(">")
        return int(digits) if digits else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

        for part in parts:
            for uri, size, start in zip(*(c.to_pylist() for c in part.columns), strict=True):
                rows, held = [], 0
                for at, content in members(uri, size, start, min(size, start + split_bytes)):
                    fields, block = parse(content)
                    kind = fields.get("warc-type")
                    told, length = fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(fields.get("x-payload-length", len(block)))
                    digest = told if kind == "revisit" else base64.b32encode(hashlib.sha1(block).digest()).decode()
                    rows.append((os.path.basename(uri), at, kind, number(fields.get("warc-record-id")), fields.get("warc-target-uri"), length if kind == "revisit" else len(block), digest, number(fields.get("warc-refers-to")), digest == told, block))
                    held += len(block)
                    if held > 8 << 20 or len(rows) == 5000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = "file string, at long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, intact boolean" + ", payload binary" * with_payload
    return spans.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path)
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
