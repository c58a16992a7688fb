import random
import re
from collections import Counter

import pytest

from lakeloom.llm import jaccard_join as J


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def plain(rows, width, percent):
    """All pairs, then components by depth-first search."""
    sets = [shingles(t, width) for _, t in rows]
    near = [[] for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                near[i].append(j)
                near[j].append(i)
    label = [None] * len(rows)
    for i in range(len(rows)):
        if label[i] is None:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            for j in group:
                label[j] = (least,)
    return Counter((rows[i][0], len(sets[i]), label[i][0]) for i in range(len(rows)))


def same(df, width, percent, spark):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = Counter(tuple(r) for r in J.join(df, width, percent).collect())
    assert got == plain(rows, width, percent)


def made(seed, n):
    """Texts with copies, chains of near copies, shared passages and common lines."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    line, passage = [word() for _ in range(12)], [word() for _ in range(60)]
    texts = []
    while len(texts) < n:
        kind = rng.random()
        own = [word() for _ in range(rng.choice([0, 1, 2, 5, 30, 80]))]
        if kind < 0.3 and texts:
            own = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if own:
                    own[rng.randrange(len(own))] = word()
        elif kind < 0.5:
            own += passage
        elif kind < 0.7:
            own += line * rng.randrange(1, 4)
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 5, 80), (3, 3, 60)])
def test_against_all_pairs(spark, seed, width, percent):
    same(spark.createDataFrame(list(enumerate(made(seed, 250))), "doc_id long, text string"), width, percent, spark)


def test_documents(spark, sf):
    same(spark.read.parquet(f"{sf}/documents.parquet"), 3, 90, spark)


def test_hard_texts(hard, spark):
    same(hard, 3, 90, spark)


def test_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        own = list(base)
        own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90, spark)


def test_prefixes_share_enough():
    rng = random.Random(6)
    import numpy as np

    levels = np.random.default_rng(1).integers(0, 12, J.CELLS).astype(np.uint8)
    for _ in range(200):
        a = {rng.randrange(1 << 60) for _ in range(rng.randrange(1, 80))}
        b = set(a)
        for _ in range(rng.randrange(0, 1 + len(a) // 8)):
            b.discard(rng.choice(sorted(b)) if b else 0)
            b.add(rng.randrange(1 << 60))
        if 100 * len(a & b) >= 80 * len(a | b):
            (x, k), (y, m) = (J.prefix(np.array(sorted(s), np.uint64), levels, 80) for s in (a, b))
            assert len(set(x.tolist()) & set(y.tolist())) >= min(k, m)


def test_keep_one(spark):
    texts = made(9, 120)
    docs = spark.createDataFrame([(i, t, i, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, node long, n string, gone int, Gone_ int")
    kept = {r.doc_id for r in J.keep_one(docs, 3, 90).collect()}
    want = plain(list(enumerate(texts)), 3, 90)
    assert kept == {i for i, n, c in want if n == 0 or c == i} and J.keep_one(docs, 3, 90).columns == docs.columns


def test_empty_table(empty):
    assert J.join(empty).count() == 0
    assert J.keep_one(empty).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_groups_around_the_threshold(spark, width, percent):
    """Copies with one to nine changed words of 150, so that many pairs of a group lie just below the threshold."""
    rng = random.Random(11)
    texts = []
    for g in range(3):
        base = [f"b{g}_{i}" for i in range(150)]
        for _ in range(80):
            own = list(base)
            for _ in range(rng.randrange(1, 10)):
                own[rng.randrange(150)] = f"x{rng.randrange(40)}"
            texts.append(" ".join(own[: rng.randrange(140, 151)]))
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width, percent, spark)


def test_least_needed_bounds_needed(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    rows = []
    for _ in range(4000):
        n = rng.randrange(1, 300)
        n_r = rng.randrange(-(-9 * n // 10), 10 * n // 9 + 1)
        size, size_r = (rng.randrange(1, min(8, J.least_overlap(x, 90)) + 1) for x in (n, n_r))
        rows.append((n, size, n_r, size_r, rng.randrange(1, n_r + 1), n_r + rng.randrange(40), rng.randrange(1, size_r + 1)))
    df = spark.createDataFrame(rows, "n int, l int, n_r int, l_r int, n_lo int, n_hi int, l_lo int")
    assert df.where(F.ceil(J.least_needed(90)) > J.needed("", "_r", 90)).count() == 0


def test_clashing_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, "x"), (1, "a b c d", 5, "x"), (2, "a b c d", 6, None), (3, None, 7, "z"), (None, "a b c d", 8, "q"), (None, None, 9, "r")], "doc_id long, text string, token int, comp string")
    assert sorted((r.token for r in J.keep_one(docs, 5, 80).collect())) == [5, 5, 7, 8, 9]


def test_full_tables_reach_the_driver_as_bytes(spark, monkeypatch):
    """A large input fills the sketch and the Bloom filter: their rows must not come to the driver one by one."""
    import numpy as np
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    frames, got = {type(spark.range(1)), DataFrame}, []
    for name in ("collect", "toPandas", "toArrow", "toLocalIterator"):
        for kind in frames:
            if hasattr(kind, name):
                monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), **b: got.append(x := f(self, *a, **b)) or x)
    J.ship(spark)
    seen = spark.range(J.LEAST_TOTAL, 200_000).select(F.lit(None).alias("n"), F.col("id").alias("cell"), F.col("id").alias("seen"))
    levels = J.frequency_levels(seen)
    want = np.zeros(J.CELLS, np.uint8)
    want[J.LEAST_TOTAL : 200_000] = np.floor(np.log2(np.arange(J.LEAST_TOTAL, 200_000) + 1))
    assert levels.dtype == np.uint8 and (levels == want).all()
    nodes = [(1 << 63) - 1, -(1 << 63), 5, *(k * 0x9E3779B97F4A7C15 % (1 << 63) for k in range(20_000))]
    bits = J.bloom(spark.createDataFrame([(n, k % 7) for k, n in enumerate(nodes)], "node long, doc_id long"))
    want = np.zeros((1 << J.BLOOM_WIDTH) // 64, np.uint64)
    for k, n in enumerate(nodes):
        for at in ((n ^ k % 7) & ((1 << J.BLOOM_WIDTH) - 1), ((n ^ k % 7) & (1 << 64) - 1) >> J.BLOOM_WIDTH & ((1 << J.BLOOM_WIDTH) - 1)):
            want[at >> 6] |= np.uint64(1 << (at & 63))
    assert (bits.view(np.uint64) == want).all()
    assert got and sum(map(len, got)) <= 600


def test_pairs_meet_at_the_ends_of_runs(spark):
    """Classes that share dozens of tokens in their common order meet at few of them, and no pair is lost."""
    rng = random.Random(21)
    classes = []
    for k in range(30):
        own = sorted({*range(40), *(rng.randrange(40, 60) for _ in range(6))} - {rng.randrange(40) for _ in range(k % 4)})
        classes.append((k, len(own) * 10, rng.randrange(1, 9), own, k % 7))
    rows = []
    for node, n, size, own, comp in classes:
        rows += [(t, node, n, size, at + 1, own[at + 1] if at + 1 < len(own) else None, comp, 0) for at, t in enumerate(own)]
    mixed = spark.createDataFrame(rows, "token long, node long, n int, l int, place int, after long, comp long, main long")
    got = Counter((r.a, r.b) for r in J.meetings(mixed, 90).collect())
    want = Counter()
    for i, (a, n, size, own, comp) in enumerate(classes):
        for b, n_b, size_b, own_b, comp_b in classes[:i]:
            if comp != comp_b and 100 * min(n, n_b) >= 90 * max(n, n_b):
                tails = [-(-90 * x // 100) - y for x, y in ((n, size), (n_b, size_b))]
                least = max(min(size, size_b), -(-90 * (n + n_b) // 190) - max(tails))
                want[b, a] = sum(min(own.index(t), own_b.index(t)) + 1 >= least for t in set(own) & set(own_b))
    want = +want
    assert set(got) == set(want) and len(want) > 200
    assert sum(got.values()) < sum(want.values()) / 3


def test_bitmaps_lose_no_link():
    import numpy as np

    rng = random.Random(31)
    told = apart = 0
    for k in range(3000):
        percent = rng.choice([60, 80, 90])
        n = rng.choice([1, 2, 3, 15, 16, 17, 60, 250, 1000])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), n - rng.randrange(n // 3 + 1))) | {rng.getrandbits(64) for _ in range(rng.randrange(n // 3 + 2))}
        x, y = (J.bitmap(np.array(sorted(s), np.uint64)) for s in (a, b))
        linked = 100 * len(a & b) >= percent * len(a | b)
        may = J.may_link(x, y, len(a), len(b), percent)
        assert may or not linked
        assert may == J.may_link(y, x, len(b), len(a), percent)
        apart += 100 * len(a & b) < (percent - 15) * len(a | b)
        told += not may and 100 * len(a & b) < (percent - 15) * len(a | b)
    assert told > 0.9 * apart > 100


def test_few_sets_travel_for_pairs_that_are_no_link(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    rows, sets = [], []
    for k in range(60):
        own = np.unique(np.concatenate([base[rng.permutation(400)[: 400 - 3 * k]], rng.integers(0, 1 << 63, 3 * k, dtype=np.uint64)]))
        sets.append(set(own.tolist()))
        rows.append((k, len(own), bytearray(J.bitmap(own).tobytes()), bytearray(own.tobytes())))
    J.ship(spark)
    table = spark.createDataFrame(rows, "node long, n long, bits binary, shingles binary")
    pairs = spark.createDataFrame([(a, b) for b in range(60) for a in range(b)], "a long, b long")
    real, near = J.staged, []
    monkeypatch.setattr(J, "staged", lambda df, what: (out := real(df, what), what == "near" and near.append(out.count()))[0])
    want = {(a, b) for b in range(60) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    found = J.links(pairs, table, 80)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 50
    assert len(want) <= near[0] < 1.5 * len(want) < 1000
