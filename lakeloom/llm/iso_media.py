"""ISO base media containers: a writer for raw 8-bit samples and a reader that walks boxes and sample tables.

The reader needs the boxes alone: it descends into container boxes (32-bit, 64-bit and to-the-end sizes), decodes the
sample tables (stts durations, stsc runs, stsz sizes, stco/co64 chunk offsets, stss sync samples) and gives codec,
duration and the byte range of each keyframe; sample payloads are never decoded. Ranges let a later task fetch single
keyframes. Each row is handled alone, so nothing is shuffled; a worker holds one Arrow batch and one container.

Defined results: null text is the empty text (one frame of padding); null or broken content of a media column gives a
null codec, duration and keyframes and the reason in error; repeated rows give repeated result rows; null doc_id stays
null; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import doc_text, ship

SIDE, RATE, GROUP, PER_CHUNK = 24, 24, 12, 16
#: A frame: SIDE x SIDE grey samples of 8 bits.
FRAME = SIDE * SIDE
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"))
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(kind: bytes, form: str, rows: list[tuple]) -> bytes:
    return full(kind, struct.pack(">I", len(rows)), b"".join(struct.pack(f">{form}", *r) for r in rows))


def write_media(payload: bytes) -> bytes:
    """A container whose one video track holds payload, a multiple of FRAME bytes, as raw grey frames."""
    n = len(payload) // FRAME
    chunks = -(-n // PER_CHUNK)
    wide = len(payload) > 0xFFFF0000
    runs = [(1, min(n, PER_CHUNK), 1)]
    if chunks > 1 and n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK, 1))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")

    def moov(start: int) -> bytes:
        offsets = [(start + i * PER_CHUNK * FRAME,) for i in range(chunks)]
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            table(b"stts", "II", [(n, 1)]),
            table(b"stss", "I", [(i + 1,) for i in range(0, n, GROUP)]),
            table(b"stsc", "III", runs),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            table(b"co64" if wide else b"stco", "Q" if wide else "I", offsets),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0))
        hdlr = full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIih", 0, 0, RATE, n, 0x10000, 0), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = len(ftyp) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return ftyp + moov(head) + box(b"mdat", payload)


#: Real files nest about ten deep; more is damage, and reported.
MOST_DEPTH = 64


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of box kinds, start and end of the content), parents first."""
    end = len(data) if end is None else end
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"cut box at {at}")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box of {size} bytes at {at}")
        yield (*path, kind), at + head, at + size
        if kind in CONTAINERS:
            if len(path) == MOST_DEPTH:
                raise ValueError(f"boxes nested over {MOST_DEPTH} deep at {at}")
            yield from walk(data, at + head, at + size, (*path, kind))
        at += size


def _rows(data: memoryview, at: int, end: int, form: str) -> list[tuple]:
    (n,) = struct.unpack_from(">I", data, at + 4)
    size = struct.calcsize(f">{form}")
    if at + 8 + n * size > end:
        raise ValueError("cut table")
    return list(struct.iter_unpack(f">{form}", data[at + 8 : at + 8 + n * size]))


class Track:
    """Codec, duration in seconds, and per sample its byte range and whether decoding can start there."""

    def __init__(self, data: memoryview, boxes: dict[bytes, tuple[int, int]]):
        at, end = boxes[b"mdhd"]
        scale, ticks = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
        at, end = boxes[b"stsd"]
        self.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
        self.kind = bytes(data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12]).decode("latin-1")
        self.ticks = sum(n * d for n, d in _rows(data, *boxes[b"stts"], "II")) or ticks
        self.scale = scale
        at, end = boxes[b"stsz"]
        size, n = struct.unpack_from(">II", data, at + 4)
        if at + 12 + 4 * n > end if size == 0 else size * n > len(data):
            raise ValueError("cut sizes")
        sizes = [size] * n if size else list(struct.unpack_from(f">{n}I", data, at + 12))
        offsets = [o for (o,) in (_rows(data, *boxes[b"co64"], "Q") if b"co64" in boxes else _rows(data, *boxes[b"stco"], "I"))]
        runs = _rows(data, *boxes[b"stsc"], "III")
        self.samples: list[tuple[int, int]] = []
        for k, (first, per, _) in enumerate(runs):
            last = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(offsets)
            for offset in offsets[first - 1 : last]:
                own = sizes[len(self.samples) : len(self.samples) + per]
                ends = list(accumulate(own, initial=offset))
                self.samples += zip(ends, ends[1:], strict=False)
        if len(self.samples) != n or any(e > len(data) for _, e in self.samples):
            raise ValueError("sample tables disagree")
        sync = [s for (s,) in _rows(data, *boxes[b"stss"], "I")] if b"stss" in boxes else range(1, n + 1)
        self.keyframes = [self.samples[s - 1] for s in sync]


def read_tracks(content: bytes) -> list[Track]:
    data, found, own = memoryview(content), [], None
    for path, start, end in walk(data):
        if path[-1] == b"trak":
            own = {}
            found.append(own)
        elif own is not None and path[:2] == (b"moov", b"trak"):
            own[path[-1]] = (start, end)
    try:
        return [Track(data, boxes) for boxes in found]
    except (KeyError, IndexError, struct.error) as e:
        raise ValueError(f"broken track: {e!r}") from e


def index_media(media: DataFrame, content: str = "content") -> DataFrame:
    """The rows of a binary column's table with codec, duration_s and keyframes (byte ranges) of their first video track, else
    of their first track. Fragments (moof) aren't decoded: such a file keeps what its moov gives, and has an error."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for value in part.column(part.num_columns - 1).to_pylist():
                try:
                    tracks = read_tracks(value) if value is not None else []
                    t = next((t for t in tracks if t.kind == "vide"), tracks[0] if tracks else None)
                    out.append((t.codec, t.ticks / t.scale if t.scale else None, [{"start": a, "end": b} for a, b in t.keyframes], "fragments not decoded" if any(p == (b"moof",) for p, *_ in walk(memoryview(value))) else None) if t else (None, None, None, "no track"))
                except (ValueError, struct.error) as e:
                    out.append((None, None, None, str(e)))
            made = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), spans, pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)

    ship(media.sparkSession)
    own = {"codec": "string", "duration_s": "double", "keyframes": "array<struct<start:bigint,end:bigint>>", "error": "string"}
    rest = [c for c in media.columns if c != content and c not in own]
    names = [*rest, *own]
    kinds = dict(media.dtypes)
    return media.select(*rest, F.col(content)).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *(f"{c} {t}" for c, t in own.items())]))


def store_texts(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Each text as a container, with what reading the container back gives.

    payload_sha256, tail_crc32 and feature come from the stored bytes, by the box walk and the sample ranges.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "n_keyframes", *["media"] * keep_media]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_keyframes long" + ", media binary" * keep_media
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.binary()]

    def row(doc_id: int | None, text: str) -> tuple:
        plain = text.encode()
        media = write_media(plain + b"\xff" * (-len(plain) % FRAME or FRAME * (not plain)))
        track = read_tracks(media)[0]
        payload = b"".join([media[a:b] for a, b in track.samples])
        ranges = "|".join(f"{a}-{b}" for a, b in track.keyframes)
        sums = zlib.crc32(b"".join([media[a:b] for a, b in track.keyframes]))
        feature = f"{track.codec.strip()};{track.kind};samples={len(track.samples)};duration={track.ticks}/{track.scale};key_crc32={sums};keyframes={ranges}"
        return (doc_id, len(plain), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, track.codec, track.ticks / track.scale, len(track.keyframes), media)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out, size = [], 0
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                out.append(row(doc_id, text))
                size += out[-1][5] if keep_media else 500
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(len(names))], names)
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(len(names))], names)

    ship(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, schema)
