import hashlib
import struct
import zlib

import pytest

from lakeloom.llm import iso_media as M


def check(rows, texts):
    for r in rows:
        plain = (texts[r.doc_id] or "").encode()
        payload = plain + b"\xff" * (-len(plain) % 576 or 576 * (not plain))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(plain), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(r.media) and hashlib.sha256(r.media).hexdigest() == r.media_sha256
        at = r.media.index(payload)
        n = len(payload) // 576
        assert r.feature.endswith("keyframes=" + "|".join(f"{at + 576 * i}-{at + 576 * i + 576}" for i in range(0, n, M.GROUP)))
        assert r.codec == "raw " and r.duration_s == n / M.RATE


def test_hard_texts(hard):
    rows = M.store_texts(hard).collect()
    assert len(rows) == hard.count()
    check(rows, {r.doc_id: r.text for r in hard.collect()})


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(M.store_texts(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_empty_table(empty):
    assert M.store_texts(empty).count() == 0


def test_media_columns(spark):
    good = M.write_media(bytes(range(256)) * 9)
    rows = spark.createDataFrame([(1, bytearray(good), "c"), (2, None, "c"), (3, bytearray(b""), "c"), (4, bytearray(good[:100]), "c"), (5, bytearray(b"\0\0\0\4abcd"), "c")], "id long, content binary, codec string")
    found = {r.id: r for r in M.index_media(rows).collect()}
    assert found[1].codec == "raw " and found[1].error is None and len(found[1].keyframes) == 1
    assert all(found[i].codec is None and found[i].error for i in (2, 3, 4, 5))


def test_variable_sizes_and_wide_boxes():
    """A hand-made file: 64-bit box size, a table of sizes, co64, two runs of chunks, no stss."""
    data = b"aaabbccccd"
    wide = lambda kind, body: struct.pack(">I4sQ", 1, kind, len(body) + 16) + body

    def moov(o):
        stbl = M.box(b"stbl", M.full(b"stsd", struct.pack(">I", 1), M.box(b"abcd")), M.table(b"stts", "II", [(3, 10), (1, 5)]), M.table(b"stsc", "III", [(1, 3, 1), (2, 1, 1)]), M.full(b"stsz", struct.pack(">6I", 0, 4, 3, 2, 4, 1)), M.table(b"co64", "Q", [(o,), (o + 9,)]))
        return M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.full(b"mdhd", struct.pack(">QQIQI", 0, 0, 10, 99, 0), version=1), M.full(b"hdlr", bytes(4), b"soun", bytes(13)), M.box(b"minf", stbl))))

    content = moov(len(moov(0)) + 16) + wide(b"mdat", data)
    (track,) = M.read_tracks(content)
    assert [content[a:b] for a, b in track.samples] == [b"aaa", b"bb", b"cccc", b"d"]
    assert (track.codec, track.kind, track.ticks, track.scale, track.keyframes) == ("abcd", "soun", 35, 10, track.samples)


def test_cut_file():
    with pytest.raises(ValueError):
        M.read_tracks(M.write_media(bytes(576))[:-1])


def test_video_track_and_fragments(spark):
    """The video track counts, also behind an audio track; a fragmented file has an error."""

    def trak(codec, kind, o):
        stbl = M.box(b"stbl", M.full(b"stsd", struct.pack(">I", 1), M.box(codec)), M.table(b"stts", "II", [(1, 5)]), M.table(b"stsc", "III", [(1, 1, 1)]), M.full(b"stsz", struct.pack(">III", 0, 1, 3)), M.table(b"stco", "I", [(o,)]))
        return M.box(b"trak", M.box(b"mdia", M.full(b"mdhd", struct.pack(">IIIII", 0, 0, 10, 99, 0)), M.full(b"hdlr", bytes(4), kind, bytes(13)), M.box(b"minf", stbl)))

    def moov(o):
        return M.box(b"moov", trak(b"mp4a", b"soun", o), trak(b"avc1", b"vide", o + 3))

    at = len(moov(0)) + 8
    both = moov(at) + M.box(b"mdat", b"aaavvv")
    rows = spark.createDataFrame([(1, bytearray(both)), (2, bytearray(both + M.box(b"moof", M.box(b"traf"))))], "id long, content binary")
    found = {r.id: r for r in M.index_media(rows).collect()}
    assert found[1].codec == "avc1" and [tuple(k) for k in found[1].keyframes] == [(at + 3, at + 6)] and found[1].error is None
    assert found[2].codec == "avc1" and found[2].keyframes == found[1].keyframes and found[2].error == "fragments not decoded"


def test_damaged_media_is_reported(spark):
    nested = b""
    for _ in range(1500):
        nested = struct.pack(">I4s", len(nested) + 8, b"moov") + nested
    good = M.write_media(bytes(576))
    at = good.find(b"stsz")
    huge = good[: at + 12] + b"\xff" * 4 + good[at + 16 :]
    rows = [(1, bytearray(nested)), (2, bytearray(huge)), (3, None), (4, bytearray(b"")), (5, bytearray(b"\0\0\0\1moov"))]
    got = {r.id: r for r in M.index_media(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert len(got) == 5 and all(r.error and r.codec is None for r in got.values())
