"""Spans of sensitive content with category and hash, never the content, and what they forbid."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.names import WHITE
from lakeloom.session import ship

#: Markers and their categories; a marker is found at every place, also inside another's span.
HEADERS = ("-----BEGIN PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----")
PREFIXES = {"sk-": "api_credential", "ghp_": "api_credential", "AKIA": "cloud_credential", "postgres://": "connection_string", "mongodb://": "connection_string"}
_SPACE = re.escape(WHITE)
MARKED = re.compile(rf"(?=({'|'.join(map(re.escape, PREFIXES))})([^{_SPACE}\"'`<>]+))")
TOKEN = re.compile(rf"[^{_SPACE}]+")
PHONE = re.compile(r"[0-9+][0-9+() -]*")
EMAIL = re.compile(r"[^@]+@.*\..*[^.]", re.DOTALL)
SPANS = "category string, byte_start long, byte_end long, span_hash string"


def spans(text: str, domain: str = "lakeloom:sensitive-span") -> list[tuple[str, int, int, str]]:
    """(category, byte_start, byte_end, hash), sorted, each once."""
    found = {("private_key", m.start(), m.end()) for h in HEADERS for m in re.finditer(re.escape(h), text)}
    found |= {(PREFIXES[m[1]], m.start(), m.end(2)) for m in MARKED.finditer(text)}
    for m in TOKEN.finditer(text):
        own = m[0].strip(",.;:()<>")
        if EMAIL.fullmatch(own):
            at = m.start() + m[0].index(own)
            found.add(("email", at, at + len(own)))
    found |= {("phone", m.start(), m.end()) for m in PHONE.finditer(text) if sum(c.isdigit() for c in m[0]) >= 10}
    # Code points to bytes, in one pass over the text.
    place, at, size = {}, 0, 0
    for i in sorted({i for _, a, b in found for i in (a, b)}):
        size += i - at if text.isascii() else len(text[at:i].encode())
        place[i], at = size, i
    return sorted((kind, place[a], place[b], hashlib.sha256(f"{domain}\0".encode() + text[a:b].encode()).hexdigest()) for kind, a, b in found)


def find(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, category, byte_start, byte_end, span_hash) of each row's text; null text has none."""
    kind = dict(rows.dtypes)[key]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, out = [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                own = spans(t or "")
                at += [i] * len(own)
                out += own
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, "category", "byte_start", "byte_end", "span_hash"])

    ship(rows.sparkSession)
    return rows.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, {SPANS}")


def metadata_text(key: str, value: str) -> str:
    """A metadata row as the scanner reads it."""
    return json.dumps({"key": key, "value": value}, ensure_ascii=False, separators=(",", ":"))


def effective(findings: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Findings without those excepted: all columns of the exceptions must agree."""
    return findings.join(exceptions.distinct(), exceptions.columns, "left_anti")


def authorize(findings: DataFrame, disclosed: DataFrame, key: str) -> DataFrame:
    """(stage, remote_allowed): embedding and organizing see everything, so any finding forbids them a remote provider;
    synthesis and critic see the disclosed rows alone."""
    everywhere = findings.limit(1).agg((F.count(F.lit(1)) == 0).alias("remote_allowed"))
    there = findings.join(disclosed.select(key), key, "left_semi").limit(1).agg((F.count(F.lit(1)) == 0).alias("remote_allowed"))
    stages = lambda df, names: df.select(F.explode(F.array(*(F.lit(n) for n in names))).alias("stage"), "remote_allowed")
    return stages(everywhere, ("embedding", "organizer")).union(stages(there, ("synthesis", "critic")))
