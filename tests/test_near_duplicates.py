"""Near duplicates against every pair, in plain Python."""

import hashlib
import random

import regex

from lakeloom import catalog
from lakeloom.operators import dedup
from tests.llm.conftest import TEXTS, spark  # noqa: F401

M = 2**64 - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


SEEDS = [mixed(i * 0x9E3779B97F4A7C15 & M) for i in range(1, 257)]


def plain(text):
    def digest(t):
        return int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")

    values, found = [ord(g) if len(g) == 1 else digest(g) for g in regex.findall(r"\X", text)], set()
    for i in range(len(values) - 4):
        run = 0
        for v in values[i : i + 5]:
            run = (run * 0x9E3779B97F4A7C15 + v) & M
        found.add(mixed(run))
    return [min(((a | 1) * h + b) & M for h in found or {digest(text)}) for a, b in zip(SEEDS[:128], SEEDS[128:], strict=True)]


def check(rows, texts):
    """Membership and pairs of representatives expand to all pairs of at least 0.85, and no others."""
    signatures = {i: plain(t or "") for i, t in texts.items()}
    same = lambda i, j: sum(x == y for x, y in zip(signatures[i], signatures[j], strict=True)) / 128
    want = {(i, j): s for i in texts for j in texts if i < j and (s := same(i, j)) >= 0.85}
    group = {i: [i] for i in texts}
    for r in rows:
        if r.kind == "member":
            group[r.left].append(r.right)
            del group[r.right]
    got = {(i, j): 1.0 for g in group.values() for i in g for j in g if i < j}
    for r in rows:
        if r.kind == "pair":
            assert r.left < r.right
            got |= {(min(i, j), max(i, j)): r.similarity for i in group[r.left] for j in group[r.right]}
    assert got == want
    return want


def test_against_all_pairs(spark):  # noqa: F811
    rng = random.Random(5)
    texts = dict(enumerate([*TEXTS, "a", "abcd", "abcd", "abce", "e\u0301abc", "e\u0301abcd", "e\u0301abcd"]))
    for _ in range(12):
        words = ["".join(rng.choices("abcdefgé漢", k=6)) for _ in range(60)]
        for changes in (0, 0, 1, 2, 3, 5):
            copy = list(words)
            for at in rng.sample(range(60), changes):
                copy[at] = "other"
            texts[len(texts)] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = check(dedup.near_duplicates(docs, "doc_id").collect(), texts)
    assert len([s for s in want.values() if s < 1]) > 10


def test_documents(spark):  # noqa: F811
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 1500")
    rows = dedup.near_duplicates(docs, "doc_id").collect()
    assert check(rows, {r.doc_id: r.text for r in docs.collect()})
    pairs = catalog.QUERIES["near_duplicates"](spark, sf).collect()
    assert {(r.left, r.right) for r in rows if r.kind == "pair"} and len(pairs) >= len(rows)
    assert {r.band for r in catalog.QUERIES["lsh_buckets"](spark, sf).collect()} == set(range(32))


def test_empty_table(spark):  # noqa: F811
    assert dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), "doc_id").count() == 0
