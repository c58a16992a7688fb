"""Exact and near duplicates."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.identity import domain_hash, parts_hash
from lakeloom.session import ship, staged

BODY = "lakeloom:body"


def exact_groups(docs: DataFrame) -> DataFrame:
    """(body_hash, canonical, n_members, doc_id): a row per member of a group of equal texts; canonical is the least doc_id.

    Null texts are equal to each other, with a null hash; members are rows, so no group is gathered.
    """
    hashed = docs.select("doc_id", domain_hash(BODY, F.col("text")).alias("body_hash"))
    groups = hashed.groupBy("body_hash").agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("n_members")).where("n_members > 1")
    return hashed.alias("a").join(groups.alias("b"), F.col("a.body_hash").eqNullSafe(F.col("b.body_hash"))).select("a.body_hash", "canonical", "n_members", "doc_id")


def representative_map(docs: DataFrame) -> DataFrame:
    """Each document's representative: the least doc_id with its text; null texts are equal to each other."""
    hashed = docs.select("doc_id", domain_hash(BODY, F.col("text")).alias("body_hash"))
    least = hashed.groupBy("body_hash").agg(F.min("doc_id").alias("representative"))
    return hashed.alias("a").join(least.alias("b"), F.col("a.body_hash").eqNullSafe(F.col("b.body_hash"))).select("doc_id", "representative")


def metadata_conflicts(docs: DataFrame) -> DataFrame:
    """Equal texts with different metadata."""
    meta = F.concat_ws("|", "lang", "source")
    return docs.groupBy(domain_hash(BODY, F.col("text")).alias("body_hash")).agg(F.count(F.lit(1)).alias("n_members"), F.countDistinct(meta).alias("n_variants")).where("n_members > 1 AND n_variants > 1")


COMPONENTS, WIDTH = 128, 5
#: Scripts whose code points are graphemes of their own as long as no others are in the text.
SIMPLE = re.compile("[\t\n\x20-\x7e\u00a0-\u02ff\u0391-\u03ce\u0400-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u205e\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]*")
STEP = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _shingles(text: str, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` graphemes; a shorter text is its only shingle."""
    if SIMPLE.fullmatch(text):
        values = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    else:
        values = np.array([ord(g) if len(g) == 1 else _digest(g) for g in regex.findall(r"\X", text)], np.uint64)
    n = len(values) - width + 1
    if n < 1:
        return np.array([_digest(text)], np.uint64)
    runs = np.zeros(n, np.uint64)
    for k in range(width):
        runs = runs * np.uint64(STEP) + values[k : k + n]
    return _mixed(runs)


def signature(text: str, components: int = COMPONENTS, width: int = WIDTH) -> np.ndarray:
    """Least value of a * shingle + b modulo 2**64, for an odd a and a b of each component."""
    seeds = _mixed(np.arange(1, 2 * components + 1, dtype=np.uint64) * np.uint64(STEP))
    a, b = seeds[:components, None] | np.uint64(1), seeds[components:, None]
    shingles, least = _shingles(text, width), np.full(components, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (a * shingles[None, at : at + 512] + b).min(axis=1), out=least)
    return least.view(np.int64)


def minhash_signatures(texts: DataFrame, key: str, components: int = COMPONENTS, width: int = WIDTH) -> DataFrame:
    """(key, signature) of each row: least hashes of the shingles of graphemes; null text counts as empty."""

    def signed(batches):
        for batch in batches:
            rows = [signature(t, components, width) for t in batch.column(1).to_pylist()]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * components)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=[key, "signature"])

    ship(texts.sparkSession)
    given = texts.select(F.col(key).cast("long").alias(key), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(signed, f"`{key}` long, signature array<long>")


def lsh_buckets(signatures: DataFrame, key: str, rows: int = 4) -> DataFrame:
    """(band, bucket, n, least): buckets that several keys share."""
    bands = signatures.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("signature") / rows).cast("int") - 1), lambda b: F.xxhash64(F.slice("signature", b * rows + 1, rows)))).alias("band", "bucket"))
    return bands.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least")).where("n > 1")


def near_duplicates(texts: DataFrame, key: str, least: float = 0.85, rows: int = 4) -> DataFrame:
    """(kind, left, right, similarity): pairs of texts whose signatures agree in a share of at least `least`.

    Rows of equal signatures form a class, whose least key represents it: `member` rows give a representative and each
    other key of its class, `pair` rows two representatives. Two keys are as similar as their representatives are.
    No pair is lost: d differing components spoil at most d bands, so a pair shares all bands but d at least.
    """
    signed = staged(minhash_signatures(texts, key), "signatures")
    need = math.ceil(least * COMPONENTS - 1e-9)
    shared = COMPONENTS // rows - (COMPONENTS - need)
    if shared < 1:
        raise ValueError("too few bands for this similarity")
    classes = staged(signed.groupBy("signature").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    several = classes.where("n > 1").select("signature", F.col("id").alias("left"))
    members = signed.join(several, "signature").where(F.col(key) > F.col("left")).select(F.lit("member").alias("kind"), "left", F.col(key).alias("right"), F.lit(1.0).alias("similarity"))
    bands = classes.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(COMPONENTS // rows - 1)), lambda b: F.xxhash64(F.slice("signature", b * rows + 1, rows)))).alias("band", "bucket"))
    l, r = (bands.select(F.col("id").alias(side), "band", "bucket") for side in ("left", "right"))
    pairs = l.join(r, ["band", "bucket"]).where("left < right").groupBy("left", "right").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared)
    x, y = (classes.select(F.col("id").alias(side), F.col("signature").alias(f"{side}_signature")) for side in ("left", "right"))
    equal = F.size(F.filter(F.zip_with("left_signature", "right_signature", lambda p, q: p == q), lambda e: e))
    scored = pairs.join(x, "left").join(y, "right").select(F.lit("pair").alias("kind"), "left", "right", (equal / F.lit(float(COMPONENTS))).alias("similarity"))
    return members.union(scored.where(F.col("similarity") >= least))


def published_signature(text: str, domain: str, components: int = COMPONENTS, width: int = WIDTH) -> list[int] | None:
    """The signature of SHA-256 hashes: of each component the least first eight bytes of the parts hash of the domain, the
    component's number and a shingle. Texts under a shingle's graphemes have none; they match equal texts alone."""
    graphemes = regex.findall(r"\X", text)
    shingles = {"".join(graphemes[i : i + width]).encode() for i in range(len(graphemes) - width + 1)}
    return [min(int.from_bytes(parts_hash(domain, c.to_bytes(4, "big"), s)[:8], "big") for s in shingles) for c in range(components)] if shingles else None


def greedy_cap(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs (left, right, similarity) that a pass from the most similar on accepts, if no key may have over `most`.

    Ties go by left and right. In rounds: a pair that is among the best undecided ones of both its ends, as many as they
    have room, fits whatever else is accepted; a pair with an end without room is out. The best pair of all is decided in
    each round, so rounds end, and each is two windows whose ranks stop at `most`.
    """
    order = lambda key: W.partitionBy(key).orderBy(F.desc("similarity"), "left", "right")
    open_pairs, accepted = staged(pairs.select("left", "right", "similarity"), "pairs"), None
    while open_pairs.limit(1).count():
        used = None
        if accepted is not None:
            used = accepted.select(F.explode(F.array("left", "right")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        now = open_pairs
        for side in ("left", "right"):
            n = F.lit(0).cast("long")
            if used is not None:
                now, n = now.join(used.select(F.col("key").alias(side), F.col("n").alias(f"{side}_n")), side, "left"), F.coalesce(f"{side}_n", F.lit(0))
            now = now.withColumn(f"{side}_room", F.lit(most) - n)
        ends = now.where("left_room > 0 AND right_room > 0")
        both = ends.select("left", "right", "similarity", F.explode(F.array(F.struct(F.col("left").alias("key"), F.col("left_room").alias("room")), F.struct(F.col("right").alias("key"), F.col("right_room").alias("room")))).alias("e"))
        ranked = both.select("left", "right", "similarity", "e.key", "e.room").withColumn("rank", F.row_number().over(order("key")))
        decided = staged(ranked.groupBy("left", "right", "similarity").agg(F.min((F.col("rank") <= F.col("room"))).alias("fits")), "decided")
        won = decided.where("fits").drop("fits")
        accepted = staged(won if accepted is None else accepted.union(won), "accepted")
        open_pairs = staged(decided.where("NOT fits").drop("fits"), "pairs")
    return pairs.limit(0).select("left", "right", "similarity") if accepted is None else accepted
