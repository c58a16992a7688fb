import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest

from lakeloom.llm import warc


def expected(pages):
    groups = defaultdict(list)
    for p in pages:
        groups[(p.html or "").encode()].append(p.page_id)
    out = Counter()
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k, i in enumerate(ids):
            out[i, len(payload), digest, "revisit" if k else "response", ids[0] if k else None] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert found(warc.round_trip(pages)) == expected(pages.collect())


def test_hard_pages(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, None, "same"), (3, "a\r\nb: c", None), (4, "u", ""), (5, "é", "漢" * 100), (None, "u", "x"), (7, "u", "x"), (8, "u", "\x00\r\n\r\nWARC/1.1"), (9, "u", "y" * (17 << 20))]
    rows += [(100 + i, "u", "hot") for i in range(50)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = found(warc.round_trip(pages))
    want = expected(pages.collect())
    assert got == want


@pytest.mark.parametrize("split", [1, 57, 1000, 1 << 20])
def test_any_split_reads_each_record_once(spark, tmp_path, split):
    pages = spark.createDataFrame([(i, f"u{i}", "page %d " % i * (i % 7)) for i in range(12 if split == 1 else 80)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(pages.coalesce(1), path)
    rows = warc.read(spark, path, split).collect()
    assert Counter(r.page_id for r in rows) == Counter(r.page_id for r in pages.collect())
    assert all(r.intact for r in rows)


def test_damage_costs_only_its_record(spark, tmp_path):
    random.seed(1)
    parts = [gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\n\r\n" % i + bytes(random.randbytes(300)), mtime=0) for i in range(5)]
    parts[2] = parts[2][:40] + b"\xff" * 20 + parts[2][60:]
    (tmp_path / "a.gz").write_bytes(b"junk" + b"".join(parts))
    rows = warc.read(spark, f"file://{tmp_path}", 100).collect()
    assert sorted(r.page_id for r in rows) == [0, 1, 3, 4]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
