import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(df, texts):
    rows = df.collect()
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == plain(texts[r.doc_id]), r
    return rows


def test_hard_texts(hard):
    more = hard.union(hard.sparkSession.createDataFrame([(100, "a b c d e a b c d e f g a b c d e", None, "", 0), (101, "a a a a a a a", None, "", 0), (102, "x|y <z> a\n a\n a\nb\x0bc", None, "", 0)], hard.schema))
    check(quality.measure(more).select("doc_id", "q.*"), {r.doc_id: r.text for r in more.collect()})


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = check(quality.judge(docs, labels), {r.doc_id: r.text for r in docs.collect()})
    assert len(rows) == docs.count() and not any(r.kept for r in rows if r.base_failed)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 5, 0.1), (0, 2000, 0.004), (3, 4000, 0.004), (10, 50_000, 0.004), (1, 3, 0.4), (900, 300_000, 0.004)])
def test_binomial_tail(spark, k, n, p):
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
    want = min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1))) if k < n * p else 1.0
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-7, abs=1e-300)


def planted(spark, n):
    """Good texts with few symbols, bad ones with many, in one stratum."""
    word = lambda i, j: f"w{i}x{j}"
    rows = [(i, " ".join(word(i, j) + ("###" if i % 5 == 0 else "") for j in range(20)), "en", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality long")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_cutoffs_need_labels_enough(spark):
    docs, labels = planted(spark, 3000)
    rows = quality.judge(docs, labels).collect()
    assert {r.doc_id for r in rows if not r.kept} == set(range(0, 3000, 5))
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {i for i in range(3000) if i % 5}
    assert all(r.kept for r in quality.judge(docs, labels.where("doc_id < 200")).collect())


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(empty, labels).count() == 0
    assert quality.keep_good(empty, labels).columns == empty.columns


def test_clashing_columns_and_no_lang(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text, "a", "b", "c", "d", 5, 6), (2, "few words", "a", "b", "c", "d", 5, 6), (1, text, None, None, None, None, None, None)], "doc_id long, text string, q string, _w string, _l string, _s string, _row int, own int")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.q or "" for r in kept.collect()) == ["", "a"]
    assert sorted((r.doc_id, r.kept, r.stratum) for r in quality.judge(docs, labels).collect()) == [(1, True, "other"), (1, True, "other"), (2, False, "other")]
