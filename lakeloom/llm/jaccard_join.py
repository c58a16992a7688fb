"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

1. Texts become sets of shingle hashes; equal sets are one class (a node), so copies cost one row. A fixed-size sketch
   of how many texts hold a shingle, summed over all texts, orders shingles from rare to common.
2. A class of n shingles emits its first n - ceil(t n) + L shingles in that order. Two linked classes share at least
   min(L, L') of these. L is chosen per class: each step lengthens the prefix by one posting but divides the expected
   number of candidates, which are at most (postings met) / L, and the L of least expected cost is taken.
3. Postings with one class are dropped. Of its other lists a class leaves the longest, by their exact lengths: as many
   as L, the sizes in a list and the tails beyond prefixes demand of any pair there, less one. A pair shares that many,
   so it meets in the shortest list that both hold, and there both classes' places among their own lists, longest
   first, meet the pair's own demand.
4. In every list all classes are first set against one pivot, the most central class, and tested; that joins most of a
   group of near copies in about as many tests as it has members. Then only pairs that the links so far leave in
   different components can still matter, and those that meet are tested too. So no link between components is lost,
   and no group is expanded into all its pairs.
5. Tests compare whole sets, of pairs that bitmaps of the sets allow: a bit of one set alone is a shingle of it alone, so
   no link is lost, and few sets travel for pairs that are no link. Components are found by label propagation with
   pointer jumping, in tables.

Posting lists are only ever counted by partial aggregates and met in joins, which adaptive execution can split; no list
is gathered in a task. Tables staged on the way are deleted when nothing reads them any more.

Nodes are 64-bit hashes of the whole sorted set. Sets are kept for classes in tested pairs alone, told by a Bloom filter
of fixed size (a full one only saves less).

Defined results: null or wordless text is the empty set, linked with nothing: its component is its own doc_id; repeated
rows give repeated result rows; a null doc_id keeps its row and has no part in the least doc_id; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.byte_bpe import batches
from lakeloom.llm.common import doc_text, drop, ship, staged
from lakeloom.llm.hashing import shingle_sets

#: Cells of the frequency sketch (a power of two) and log2 of the Bloom filter's bits; what a task must see to report a
#: cell, and what all tasks must.
CELLS, BLOOM_WIDTH, LEAST_SEEN, LEAST_TOTAL = 1 << 22, 26, 6, 12
MOST_MATCHES = 8
#: Cost of testing a candidate (two sets travel) against that of a posting; other texts met at a shingle not in the sketch.
TEST_COST, RARE = 200, 0.1
SEEN_NODES = 500_000
#: log2 of the numbers in a block of a table that executors pack for the driver.
BLOCK_WIDTH = 14


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set linked to it, at least."""
    return -(-percent * n // 100)


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.sha1(shingles.tobytes()).digest()[:8], "little", signed=True)


def _sets(part: pa.RecordBatch, width: int):
    rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
    for some in batches(rows, 1 << 20):
        yield [i for i, _ in some], shingle_sets([t for _, t in some], width)


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)


def classify(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, n, node), and rows (cell, seen) of the frequency sketch with a null n."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = np.zeros(CELLS, np.int32), set()
        for part in parts:
            for ids, sets in _sets(part, width):
                rows = []
                for i, s in zip(ids, sets, strict=True):
                    node = node_of(s) if len(s) else None
                    rows.append((i, len(s), node, None, None))
                    if node is not None and node not in seen:  # a copy in the same task is no evidence
                        if len(seen) < SEEN_NODES:
                            seen.add(node)
                        cells[(s & np.uint64(CELLS - 1)).astype(np.int64)] += 1
                yield _columns(rows, kinds, names)
        often = np.flatnonzero(cells >= LEAST_SEEN)
        for at in range(0, len(often), 100_000):
            some = often[at : at + 100_000]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(some, pa.int64()), pa.array(cells[some], pa.int64())], names)

    names, kinds = ["doc_id", "n", "node", "cell", "seen"], [pa.int64()] * 5
    return doc_text(docs).mapInArrow(run, "doc_id long, n long, node long, cell long, seen long")


def packed(rows: DataFrame, size: int, kind: type) -> np.ndarray:
    """size numbers: the second column of each row, at the place that the first names; the others are 0.

    Executors write the rows into blocks of bytes, so a full table costs the driver its bytes and not millions of rows.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for part in parts:
            at, value = (part.column(k).to_numpy() for k in range(2))
            which = at >> BLOCK_WIDTH
            for b in np.unique(which).tolist():
                own = which == b
                blocks.setdefault(b, np.zeros(1 << BLOCK_WIDTH, kind))[at[own] & ((1 << BLOCK_WIDTH) - 1)] = value[own]
        for b, cells in blocks.items():
            yield _columns([(b, cells.tobytes())], [pa.int64(), pa.binary()], ["block", "cells"])

    at, value = rows.columns
    dealt = rows.select(F.col(at).cast("long").alias("at"), value).repartition(F.shiftright("at", BLOCK_WIDTH))
    out = np.zeros(-(-size >> BLOCK_WIDTH) << BLOCK_WIDTH, kind)
    for b, cells in dealt.mapInArrow(run, "block long, cells binary").collect():
        out[b << BLOCK_WIDTH : (b + 1) << BLOCK_WIDTH] = np.frombuffer(cells, kind)
    return out[:size]


def frequency_levels(rows: DataFrame) -> np.ndarray:
    """log2 of the texts seen by cell: CELLS bytes."""
    total = rows.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= LEAST_TOTAL)
    return packed(total.select("cell", F.floor(F.log2(F.col("seen") + 1)).cast("byte").alias("level")), CELLS, np.uint8)


def prefix(shingles: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(prefix in the common order, matches L that a partner must share)."""
    n = len(shingles)
    level = levels[(shingles & np.uint64(CELLS - 1)).astype(np.int64)]
    order = np.lexsort((shingles, level))
    short = n - least_overlap(n, percent)
    most = min(MOST_MATCHES, least_overlap(n, percent))
    known = level[order[: short + most]].astype(np.float64)
    met = np.cumsum(np.where(known > 0, np.exp2(known) - 1, RARE))[short:]
    matches = np.arange(1, most + 1)
    best = int(np.argmin(met + matches + TEST_COST * met / matches)) + 1
    return shingles[order[: short + best]], best


def postings(docs: DataFrame, levels, width: int, percent: int) -> DataFrame:
    """(token, node, n, l): the prefix of each class, once per task that holds it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = levels.value, set()
        for part in parts:
            for _, sets in _sets(part, width):
                tokens, nodes, sizes, matches = [], [], [], []
                for s in sets:
                    if not len(s) or (node := node_of(s)) in seen:
                        continue
                    if len(seen) < SEEN_NODES:
                        seen.add(node)
                    own, best = prefix(s, known, percent)
                    tokens.append(own)
                    nodes.append(node)
                    sizes.append(len(s))
                    matches.append(best)
                if tokens:
                    k = np.array([len(t) for t in tokens])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), k)), pa.array(np.repeat(np.array(sizes, np.int32), k)), pa.array(np.repeat(np.array(matches, np.int32), k))], ["token", "node", "n", "l"])

    return doc_text(docs).mapInArrow(run, "token long, node long, n int, l int")


def shared_postings(rows: DataFrame, percent: int) -> DataFrame:
    """Postings (token, node, n, l, place, after) at which a class can meet another that is similar enough.

    place: the posting's number among the class's shared postings, longest lists first. Of the tokens that a pair shares,
    take the one with the shortest list: needed() - 1 others come before it in both classes. So a posting counts only if
    its place is the least_needed() of its list, at least.
    after: the token of the class's next place, null at the last.
    """
    every = staged(rows, "postings")
    by_token = every.repartition("token")
    # The aggregates read all columns, so that they and the join share one exchange; both stream over a list's rows.
    extent = [F.count(F.lit(1)).alias("heat"), F.min("node").alias("low"), F.max("node").alias("high"), F.min("n").alias("n_lo"), F.min("l").alias("l_lo")]
    lists = by_token.groupBy("token").agg(*extent).where("low <> high AND n_lo > 0 AND l_lo > 0")
    shared = by_token.join(lists.select("token", "heat"), "token").repartition("node")  # one exchange for the copies of a class and for places
    once = shared.groupBy("node", "token").agg(F.max("heat").alias("heat"), F.max("n").alias("n"), F.max("l").alias("l"))
    order = W.partitionBy("node").orderBy(F.desc("heat"), "token")
    place, after = F.row_number().over(order), F.lead("token").over(order)
    placed = staged(once.select("token", "node", "n", "l", place.alias("place"), after.alias("after")), "placed")
    drop(every)
    bounds = placed.groupBy("token").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("l").alias("l_lo"))
    core = staged(placed.join(bounds, "token").where(F.col("place") >= least_needed(percent)).select(placed.columns), "core")
    drop(placed)
    return core


def pivot_pairs(core: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a class and the pivot of a token that both hold, where their places allow a link.

    The pivot is the class with the largest share of its prefix in shared postings: of a group of near copies the one
    that differs least from the others.
    """
    share = F.max("place") / (F.max("n") - F.max(tail("n", "l", percent)))
    central = core.groupBy("node").agg(share.alias("share"))
    best = F.max(F.struct("share", F.xxhash64("node").alias("h"), "node", "n", "l", "place")).alias("pivot")
    pivots = core.join(central, "node").groupBy("token").agg(best)
    named = pivots.select("token", *(F.col(f"pivot.{c}").alias(f"{c}_p") for c in ("node", "n", "l", "place")))
    met = core.join(named, "token").where((F.col("node") != F.col("node_p")) & can_link("_p", percent))
    return met.select(F.least("node", "node_p").alias("a"), F.greatest("node", "node_p").alias("b")).distinct()


def tail(n: str, l: str, percent: int) -> Column:  # noqa: E741
    """Shingles of a set that its prefix leaves out."""
    return F.ceil(F.lit(percent) * F.col(n) / 100) - F.col(l)


def needed(a: str, b: str, percent: int) -> Column:
    """Prefix shingles that linked sets share at least; a and b are the suffixes of their columns n and l.

    Of the set whose prefix ends first in the common order, shared shingles lie in both prefixes or in its tail, so the
    overlap is at most what the prefixes share and the longer tail.
    """
    total = F.col(f"n{a}") + F.col(f"n{b}")
    overlap = F.ceil(F.lit(percent) * total / (100 + percent))
    return F.greatest(F.least(f"l{a}", f"l{b}").cast("long"), overlap - F.greatest(tail(f"n{a}", f"l{a}", percent), tail(f"n{b}", f"l{b}", percent)))


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def can_link(other: str, percent: int) -> Column:
    """Whether sizes and places of two classes at a common token allow a link."""
    enough = F.least("place", f"place{other}") >= needed("", other, percent)
    return sizes_allow(F.col("n"), F.col(f"n{other}"), percent) & enough


def least_needed(percent: int) -> Column:
    """A bound from below of needed() for a posting (n, l) and any other of its list, from the list's n_lo, n_hi and l_lo."""
    lo = F.greatest("n_lo", F.ceil(F.lit(percent) * F.col("n") / 100))
    hi = F.least("n_hi", F.floor(100 * F.col("n") / percent))
    shared = lambda other: percent * (F.col("n") + other) / (100 + percent)
    # needed() is least either at the least partner, by this set's own tail, or at the largest, by the partner's.
    by_size = F.least(shared(lo) - tail("n", "l", percent), shared(hi) - F.lit(percent) * hi / 100 - 1 + F.col("l_lo"))
    return F.greatest(F.least("l", "l_lo").cast("double"), by_size - 1e-6)


def bit_of(k: int) -> Column:
    """A node is a hash already, so its own bits serve; a doc_id changes the low ones."""
    key = F.col("node").bitwiseXOR(F.coalesce("doc_id", F.lit(0).cast("long")))
    return F.shiftrightunsigned(key, BLOOM_WIDTH * k).bitwiseAND(F.lit((1 << BLOOM_WIDTH) - 1))


def bloom(owners: DataFrame) -> np.ndarray:
    """2 ** BLOOM_WIDTH bits, two for each (node, doc_id)."""
    bit = F.explode(F.array(*(bit_of(k) for k in range(2)))).alias("bit")
    words = owners.select(bit).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    return packed(words, (1 << BLOOM_WIDTH) // 64, np.int64)


def in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (node ^ doc_id) the filter holds."""
    mask, words = np.uint64((1 << BLOOM_WIDTH) - 1), bits.view(np.uint64)
    ok = np.ones(len(keys), bool)
    for k in range(2):
        at = keys >> np.uint64(BLOOM_WIDTH * k) & mask
        ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each value of the shingles' low bits, in bytes: a power of two of at least four bits a shingle."""
    size = 1 << max(6, (4 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def may_link(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether two sets of n and m shingles may be linked, by their bitmaps: a bit of one alone is a shingle of it alone."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(b.reshape(-1, size), axis=0).view(np.uint64) for b in (x, y))  # a longer one folds to the shorter's bits
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return 100 * most >= percent * (n + m - most)


def class_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, bits, shingles) of the given nodes, from the row of least doc_id that has the set; a few rows more do no harm.

    The sets and their bitmaps are written where they are made: the rows wanted are told by a Bloom filter, and nothing is
    shuffled.
    """
    owners = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    maybe = docs.sparkSession.sparkContext.broadcast(bloom(owners))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["node", "n", "bits", "shingles"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for part in parts:
            for ids, sets in _sets(part, width):
                some = [(i or 0, node_of(s), s) for i, s in zip(ids, sets, strict=True) if len(s)]
                ok = in_bloom(maybe.value, np.array([node ^ i for i, node, _ in some], np.int64).view(np.uint64))
                rows = [(node, len(s), bitmap(s).tobytes(), s.tobytes()) for k, (_, node, s) in enumerate(some) if ok[k]]
                if rows:
                    yield _columns(rows, kinds, names)

    return doc_text(docs).mapInArrow(run, "node long, n long, bits binary, shingles binary")


def close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that bitmaps allow: no link is lost, and of the others those near the threshold are left."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x, y = ([np.frombuffer(b.as_buffer(), np.uint8) for b in part.column(k)] for k in (2, 4))
            n, m = (part.column(k).to_pylist() for k in (3, 5))
            ok = [may_link(*one, percent) for one in zip(x, y, n, m, strict=True)]
            yield part.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "n_a", "y", "n_b").mapInArrow(run, "a long, b long")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; a staged table.

    Bitmaps travel for all pairs, whole sets only for those that they leave; a Bloom filter tells those before a shuffle.
    """
    near = staged(close(pairs, sets, percent), "near")
    maybe = pairs.sparkSession.sparkContext.broadcast(bloom(ends(near).withColumn("doc_id", F.lit(0).cast("long"))))

    def wanted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(in_bloom(maybe.value, part.column(0).to_numpy().view(np.uint64))))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ok = []
            for x, y in zip(part.column(2), part.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield part.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    some = sets.select("node", "shingles").mapInArrow(wanted, "node long, shingles binary")
    left = some.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = some.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    found = staged(near.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    drop(near)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node with an edge: comp is the least node that edges reach."""
    both = staged(edges.union(edges.select("b", "a")).toDF("node", "other"), "edges")
    comp = staged(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")), "comp")
    while True:
        seen = both.join(comp.withColumnsRenamed({"node": "other", "comp": "theirs"}), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        near = comp.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "theirs").alias("comp"))
        # Pointer jumping: a node takes the component of its component.
        root = near.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = staged(near.join(root, "comp", "left").select("node", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp")), "comp")
        drop(comp)
        if not new.where("old <> comp").limit(1).count():
            drop(both)
            return new.select("node", "comp")
        comp, comp._lakeloom_path = new.select("node", "comp"), new._lakeloom_path


def meetings(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components at the tokens whose sizes and places allow a link.

    Where the same token comes next in both classes, they meet there too, at higher places, so a pair is left to the end
    of each run of tokens that both have.
    """
    rest = mixed.where("comp <> main").select("token", *(F.col(c).alias(f"{c}_r") for c in ("node", "n", "l", "comp", "place", "after")))
    # A pair outside the token's main component would come twice.
    once = (F.col("comp") == F.col("main")) | (F.col("node_r") < F.col("node"))
    run_ends = F.coalesce(F.col("after") != F.col("after_r"), F.lit(True))
    met = rest.join(mixed, "token").where((F.col("comp") != F.col("comp_r")) & once & run_ends & can_link("_r", percent))
    return met.select(F.least("node", "node_r").alias("a"), F.greatest("node", "node_r").alias("b"))


def open_pairs(core: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components whose sizes and places at a common token allow a link."""
    named = staged(core.join(comp, "node", "left").select(*core.columns, F.coalesce("comp", "node").alias("comp")), "named")
    counts = named.groupBy("token", "comp").count()
    main = counts.groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = staged(named.join(main.drop("comps"), "token"), "mixed")
    drop(named)
    pairs = staged(meetings(mixed, percent).distinct(), "pairs")
    drop(mixed)
    return pairs


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def link_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, node) of every row, (node, comp) of every class with a link to another)."""
    spark = docs.sparkSession
    ship(spark)
    rows = staged(classify(docs, width), "classes")
    levels = spark.sparkContext.broadcast(frequency_levels(rows))
    core = shared_postings(postings(docs, levels, width, percent), percent)
    star = staged(pivot_pairs(core, percent), "star")
    sets = staged(class_sets(docs, rows, ends(star), width), "sets")
    found = links(star, sets, percent)
    comp = components(found)
    pairs = open_pairs(core, comp, percent)
    rest = staged(pairs.join(star, ["a", "b"], "left_anti"), "rest")
    drop(core, star, pairs)
    if rest.limit(1).count():
        new = staged(ends(rest).join(sets.select("node").distinct(), "node", "left_anti"), "new")
        more = staged(class_sets(docs, rows, new, width), "sets")
        others = links(rest, sets.union(more), percent)
        comp = components(found.union(others))
        drop(new, more, others)
    drop(sets, found, rest)
    return rows.where("n IS NOT NULL").select("doc_id", "n", "node"), comp


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links reach) of each row."""
    rows, comp = link_classes(docs, width, percent)
    classes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = classes.join(comp, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "comp").select("node", "component_id")
    done = rows.where("n > 0").join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return done.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with only the least doc_id of each component; wordless rows, rows without doc_id and repeats of a row stay."""
    found = join(docs, width, percent).where((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id")))
    gone = "gone"
    while gone in (c.lower() for c in docs.columns):
        gone += "_"
    return docs.join(found.select(F.col("doc_id").alias(gone)).distinct(), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
