import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lakeloom.llm import katz


class Plain:
    """The same model in dictionaries."""

    def __init__(self, rows):
        self.one, self.two, self.of = Counter(), Counter(), Counter()
        for i, t in rows:
            if i is not None and not self.held(i):
                for v, w in self.pairs(t):
                    self.one[w] += 1
                    self.two[v, w] += 1
                    self.of[v] += 1
        self.n = sum(self.one.values())
        self.d1, self.d2 = (katz.discounts(Counter(c.values())) for c in (self.one, self.two))
        self.unknown = 1 - sum(self.p1(w) for w in self.one)
        self.alpha, self.after = {}, defaultdict(set)
        for v, w in self.two:
            self.after[v].add(w)

    held = staticmethod(lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2)

    @staticmethod
    def pairs(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return list(zip(["<s>", *words], [*words, "</s>"], strict=True))

    def p1(self, w):
        c = self.one[w]
        return (self.d1[c] if c <= 5 else 1) * c / (self.n + katz.DELTA) if c else self.unknown

    def p2(self, v, w):
        if c := self.two[v, w]:
            return (self.d2[c] if c <= 5 else 1) * c / (self.of[v] + katz.DELTA)
        if not self.of[v]:
            return self.p1(w)
        if v not in self.alpha:
            left = 1 - sum(self.p2(v, x) for x in self.after[v])
            self.alpha[v] = left / (1 - sum(self.p1(x) for x in self.after[v]))
        return self.alpha[v] * self.p1(w)


def check(df, monkeypatch=None):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    model = Plain(rows)
    want = Counter()
    for i, t in rows:
        pairs = model.pairs(t)
        base = sum(math.log10((model.one[w] + 1) / (model.n + len(model.one) + 1)) for _, w in pairs)
        score = sum(math.log10(max(model.p2(v, w), 1e-300)) for v, w in pairs)
        want[i, model.held(i), len(pairs), sum(model.one[w] > 0 for _, w in pairs), model.n, round(base, 6), round(score, 6)] += 1
    got = Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in katz.score(df).collect())
    assert got == want
    return model


def test_documents_are_scored_as_by_the_plain_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    model = check(docs.repartition(3))
    for v in ["<s>", "the", "never seen", *list(model.of)[:10]]:
        assert sum(model.p2(v, w) for w in model.one) + model.p2(v, "unknown word") == pytest.approx(1)


def test_hard_texts(hard):
    check(hard)


def test_only_held_out_rows(spark):
    held = [i for i in range(100) if Plain.held(i)][:5]
    check(spark.createDataFrame([(i, "a b a") for i in held], "doc_id long, text string"))


def test_split_contexts(spark, monkeypatch):
    """A context that holds most of the corpus lies in several buckets."""
    rows = [(i, " ".join(f"the w{(i * 7 + k) % 97}" for k in range(20))) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_held_out_likelihood(spark):
    rows = katz.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]


def test_empty_table(empty):
    assert katz.score(empty).count() == 0
