"""Katz backoff over bigrams, with Good-Turing discounts and exactly normalised backoff weights.

p(w | v) = d(c) c(vw) / (c(v) + DELTA) for a bigram seen in training, else alpha(v) p(w), and p(w) = d(c) c(w) /
(N + DELTA) for a known word, else what is left, which is the probability of the unknown word. d(c) is Katz's
Good-Turing ratio up to MOST_DISCOUNTED counts and 1 beyond; alpha(v) = (1 - sum of p(w | v)) / (1 - sum of p(w)), both
over the words seen after v, so every context's probabilities sum to one. Texts start in a start context and end with
an end token. Evaluation recurs per token: bigram, else the weight of its context and the unigram, else the unknown.

Tables instead of broadcasts. The corpus is read three times, in chunks of at most CHUNK_BYTES of a partition's text:
1. every chunk sends its distinct words and their training counts to buckets by hash; a bucket adds up and answers each
   chunk with the corpus counts of its words (a table partitioned by chunk in the shared folder);
2. every chunk sends its distinct bigrams, by context, with the corpus counts of their second words; a bucket adds up and
   answers with the bigrams' counts, and for contexts with an unseen bigram with their histogram of counts and sum p(w);
3. every chunk looks its tokens up in its two answers and scores its texts.
A chunk asks for each word and bigram once however often it occurs, and a context with more than its share of the
corpus is split over several buckets by second word, whose answers the chunk adds up. Only counts of counts reach the
driver. Number of buckets and chunks grow with the input; a bucket's and a chunk's memory don't.

Words are known by 64-bit hashes, and a bigram's second word by 40 bits of it inside its context.

Defined results: null text is empty (only the end token); a null doc_id is neither held out nor learnt from; repeated
rows count and score each; further columns are ignored; an empty table gives no rows. Without any training rows every
word is unknown and p(unknown) = 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import doc_text, input_bytes, scratch, ship, staged
from lakeloom.llm.hashing import mix, word_hashes

FOLDS, HELD_OUT = 7, 2
MOST_DISCOUNTED, DELTA = 5, 0.5
CHUNK_BYTES, BUCKET_BYTES = 14 << 20, 16 << 20
END, START = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
#: A context is split if it holds more than this share of a mean bucket.
SHARE = 4


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays (with their kinds and lengths) as compressed bytes."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays))


def unblob(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for part in raw[4 : 4 + n].decode().split(";"):
        kind, _, k = part.partition(",")
        a = np.frombuffer(raw, kind, int(k), at)
        at += a.nbytes
        out.append(a)
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; rises with the hash, so sorted hashes are sorted by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class Chunk:
    """Words of some texts: distinct hashes, and each token's word and context."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in rows]
        hashes, counts = word_hashes([t for _, t in rows])
        self.counts = counts + 1
        ends = np.cumsum(self.counts) - 1
        tokens = np.empty(int(self.counts.sum()), np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner], tokens[ends] = hashes, END
        self.held = np.array([held_out(i) for i in self.ids], bool)
        learn = ~self.held & np.array([i is not None for i in self.ids], bool)
        self.learn = np.repeat(learn, self.counts)
        self.words, self.word = np.unique(tokens, return_inverse=True)
        self.seen = np.bincount(self.word[self.learn], minlength=len(self.words)).astype(np.uint32)
        self.n_learnt = int(learn.sum())
        #: Context of each token: a word's number, or len(words) at a text's start.
        self.context = np.concatenate([[len(self.words)], self.word[:-1]])
        self.context[np.concatenate([[0], ends[:-1] + 1])] = len(self.words)

    def bigrams(self, known: np.ndarray, n: int, learnt: int, buckets: int) -> None:
        """Distinct bigrams, sorted by the key of their context part. known: corpus counts of the words."""
        size = np.uint64(len(self.words) + 1)
        pairs, self.pair = np.unique(self.context.astype(np.uint64) * size + self.word.astype(np.uint64), return_inverse=True)
        v, w = (pairs // size).astype(np.int64), (pairs % size).astype(np.int64)
        self.context_count = np.append(known, learnt).astype(np.float64)
        name = np.append(self.words, START)
        parts = 1 + (self.context_count * buckets * SHARE // max(1, n)).astype(np.int64)
        key = lambda v, part: mix(name[v] + part.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        keys = key(v, (self.words[w] >> np.uint64(7)).astype(np.int64) % parts[v])
        order = np.lexsort((self.words[w], keys))
        self.v, self.w, keys = v[order], w[order], keys[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[self.pair]
        self.pair_seen = np.bincount(self.pair[self.learn], minlength=len(order)).astype(np.uint32)
        # All parts of a split context are asked for.
        split = np.unique(v[parts[v] > 1])
        more_v = np.repeat(split, parts[split])
        more = key(more_v, np.arange(len(more_v)) - np.repeat(np.cumsum(parts[split]) - parts[split], parts[split]))
        all_keys, owner = np.concatenate([keys, more]), np.concatenate([self.v, more_v])
        self.keys, first = np.unique(all_keys, return_index=True)
        self.key_v = owner[first]
        self.key_split = parts[self.key_v] > 1
        self.runs = np.bincount(np.searchsorted(self.keys, keys), minlength=len(self.keys)).astype(np.uint32)


def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    """(chunk number, chunk) of a partition's rows: the same in each pass over the same partitions."""
    base, number = TaskContext.get().partitionId() << 20, 0
    rows, size = [], 0
    for part in parts:
        for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if rows and size + len(row[1]) > CHUNK_BYTES:
                yield base + number, Chunk(rows)
                rows, size, number = [], 0, number + 1
            rows.append(row)
            size += len(row[1])
    if rows:
        yield base + number, Chunk(rows)


def discounts(of_counts: dict[int, int]) -> np.ndarray:
    """Katz's d(r) for r = 0..MOST_DISCOUNTED, from counts of counts, kept within (0, 1)."""
    k, n = MOST_DISCOUNTED, lambda r: of_counts.get(r, 0)
    out = np.ones(k + 1)
    cut = (k + 1) * n(k + 1) / n(1) if n(1) else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n(r + 1) / (r * n(r)) - cut) / (1 - cut) if n(r) and cut < 1 else 1.0
        out[r] = min(0.99, max(0.05, d))
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= MOST_DISCOUNTED, d[np.minimum(counts, MOST_DISCOUNTED).astype(np.int64)], 1.0)


class Unigrams:
    """p(w) as a function of the corpus count."""

    def __init__(self, n: int, types: int, learnt: int, of_counts: dict[int, int]):
        self.n, self.types, self.learnt = n, types, learnt
        self.d = discounts(of_counts)
        kept = n - sum(r * of_counts.get(r, 0) * (1 - self.d[r]) for r in range(1, MOST_DISCOUNTED + 1))
        self.unknown = 1 - kept / (n + DELTA)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / (self.n + DELTA), self.unknown)


MESSAGE = "bucket long, chunk long, payload binary"


def _messages(number: int, buckets: np.ndarray, payload) -> pa.RecordBatch:
    """A message to each bucket; buckets (sorted) of the items, payload(start, end) of a run of items."""
    which, start = np.unique(buckets, return_index=True)
    end = np.append(start[1:], len(buckets))
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([number] * len(which), pa.int64()), pa.array([payload(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())], ["bucket", "chunk", "payload"])


def _sum_words(table: pa.Table) -> pa.Table:
    """A bucket of words: answers with corpus counts, and counts of counts (chunk -1)."""
    parts = [unblob(p) for p in table.column("payload").to_pylist()]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
    ends = np.cumsum([len(p[0]) for p in parts])
    answers = [blob(x.astype(np.uint32)) for x in np.split(total[at], ends[:-1])]
    return _answers(table, answers, total)


def _answers(table: pa.Table, answers: list[bytes], total: np.ndarray) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    often = np.bincount(np.minimum(total, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)
    stats = blob(np.array([total.sum(), (total > 0).sum(), *often], np.int64))
    return pa.table({"bucket": pa.array([bucket] * (len(answers) + 1), pa.int64()), "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()), "payload": pa.array([*answers, stats], pa.binary())})


def _sum_bigrams(table: pa.Table, unigrams: Unigrams) -> pa.Table:
    """A bucket of context parts: answers with bigram counts and the statistics of contexts that need them."""
    parts = [unblob(p) for p in table.column("payload").to_pylist()]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    runs = np.concatenate([p[2] for p in parts]).astype(np.int64)
    context = np.repeat(at, runs)
    second = np.concatenate([p[3].astype(np.uint64) << np.uint64(8) | p[4] for p in parts])
    pairs, first, pair = np.unique(context.astype(np.uint64) << np.uint64(40) | second, return_index=True, return_inverse=True)
    total = np.bincount(pair, np.concatenate([p[5] for p in parts]), len(pairs)).astype(np.int64)
    own, p_word = context[first], unigrams.p(np.concatenate([p[6] for p in parts])[first].astype(np.int64))
    stats = np.zeros((len(keys), MOST_DISCOUNTED + 2))
    for r in range(1, MOST_DISCOUNTED + 1):
        stats[:, r - 1] = np.bincount(own, total == r, len(keys))
    stats[:, -2] = np.bincount(own, total * (total > MOST_DISCOUNTED), len(keys))
    stats[:, -1] = np.bincount(own, p_word * (total > 0), len(keys))
    answers, key_at, pair_at = [], 0, 0
    for k, split, run, low, *_ in parts:
        of_key, counts = at[key_at : key_at + len(k)], total[pair[pair_at : pair_at + len(low)]]
        unseen = np.bincount(np.repeat(np.arange(len(k)), run.astype(np.int64)), counts == 0, len(k)) > 0
        asked = np.flatnonzero(unseen | split.astype(bool))
        answers.append(blob(counts.astype(np.uint32), asked.astype(np.uint32), stats[of_key[asked]].reshape(-1)))
        key_at, pair_at = key_at + len(k), pair_at + len(low)
    return _answers(table, answers, total)


def _exchange(messages: DataFrame, add, what: str, partitions: int) -> tuple[str, list[np.ndarray]]:
    """Path of the answers, a table partitioned by chunk, and the buckets' statistics added up."""
    spark = messages.sparkSession
    answers = staged(messages.groupBy("bucket").applyInArrow(add, MESSAGE), f"{what}-answers")
    path = scratch(spark, what)
    answers.where("chunk >= 0").repartition(partitions, "chunk").sortWithinPartitions("chunk", "bucket").write.partitionBy("chunk").parquet(path)
    # Statistics are nine numbers a bucket; their sum is formed in tasks.
    rows = answers.where("chunk < 0").select("payload")

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(MOST_DISCOUNTED + 5, np.int64)
        for part in parts:
            for p in part.column(0).to_pylist():
                out += unblob(p)[0]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], [f"s{i}" for i in range(len(out))])

    names = [f"s{i}" for i in range(MOST_DISCOUNTED + 5)]
    sums = rows.mapInArrow(total, ", ".join(f"{n} long" for n in names)).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    return path, list(sums)


def _read(path: str, number: int) -> list[list[np.ndarray]]:
    """The answers to a chunk, by bucket."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(f"{path}/chunk={number}")
    table = ds.dataset(inner, filesystem=store, format="parquet").to_table(columns=["bucket", "payload"]).sort_by("bucket")
    return [unblob(p) for p in table.column("payload").to_pylist()]


def _known(path: str, number: int, chunk: Chunk) -> np.ndarray:
    known = np.concatenate([a[0] for a in _read(path, number)])
    if len(known) != len(chunk.words):
        raise RuntimeError(f"chunk {number} differs between passes: its table's partitions have changed")
    return known.astype(np.int64)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    ship(spark)
    # The passes must see the same partitions, also if executors come or go between them.
    files = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", files or str(spark.sparkContext.defaultParallelism))
    try:
        return _score(doc_text(docs))
    finally:
        if files is None:
            spark.conf.unset("spark.sql.files.minPartitionNum")


def _score(texts: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(texts) // BUCKET_BYTES)

    def send_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in chunks(parts):
            yield _messages(number, bucket_of(c.words, buckets), lambda a, b, c=c: blob(c.words[a:b], c.seen[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([c.n_learnt]), pa.array([b""])], ["bucket", "chunk", "payload"])

    sent = staged(texts.mapInArrow(send_words, MESSAGE), "words")
    learnt = sent.where("bucket < 0").agg(F.coalesce(F.sum("chunk"), F.lit(0))).first()[0]
    words, sums = _exchange(sent.where("bucket >= 0"), _sum_words, "katz-words", buckets)
    n, types, often = sums[0], sums[1], sums[2:]
    unigrams = Unigrams(n, types, learnt, dict(enumerate(often)))

    def send_bigrams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in chunks(parts):
            known = _known(words, number, c)
            c.bigrams(known, n, learnt, buckets)
            ends = np.cumsum(c.runs.astype(np.int64))
            second = c.words[c.w] & np.uint64((1 << 40) - 1)
            low, high = (second & np.uint64(255)).astype(np.uint8), (second >> np.uint64(8)).astype(np.uint32)

            def payload(a: int, b: int, c=c, known=known, ends=ends, low=low, high=high) -> bytes:
                i, j = int(ends[a - 1]) if a else 0, int(ends[b - 1])
                return blob(c.keys[a:b], c.key_split[a:b].astype(np.uint8), c.runs[a:b], high[i:j], low[i:j], c.pair_seen[i:j], known[c.w[i:j]].astype(np.uint32))

            yield _messages(number, bucket_of(c.keys, buckets), payload)

    pairs, sums = _exchange(texts.mapInArrow(send_bigrams, MESSAGE), lambda t: _sum_bigrams(t, unigrams), "katz-bigrams", buckets)
    d = discounts(dict(enumerate(sums[2:])))

    def evaluate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in chunks(parts):
            known = _known(words, number, c)
            c.bigrams(known, n, learnt, buckets)
            counts, stats = [], np.zeros((len(c.words) + 1, MOST_DISCOUNTED + 2))
            at = np.searchsorted(bucket_of(c.keys, buckets), np.unique(bucket_of(c.keys, buckets)))
            for first, (own, asked, values) in zip(at.tolist(), _read(pairs, number), strict=True):
                counts.append(own)
                np.add.at(stats, c.key_v[first + asked.astype(np.int64)], values.reshape(len(asked), MOST_DISCOUNTED + 2))
            yield _scores(c, known, np.concatenate(counts).astype(np.int64), stats, unigrams, d)

    # Scored here, while the partitions are held alike.
    return staged(texts.mapInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "katz-scores")


def _scores(c: Chunk, known: np.ndarray, counts: np.ndarray, stats: np.ndarray, unigrams: Unigrams, d: np.ndarray) -> pa.RecordBatch:
    p_word = unigrams.p(known)
    of_context = c.context_count + DELTA
    seen_mass = (stats[:, :MOST_DISCOUNTED] * d[1:] * np.arange(1, MOST_DISCOUNTED + 1)).sum(1) + stats[:, -2]
    alpha = np.where(c.context_count > 0, (1 - seen_mass / of_context) / np.maximum(1 - stats[:, -1], 1e-12), 1.0)
    p = np.where(counts > 0, discounted(counts, d) / of_context[c.v], alpha[c.v] * p_word[c.w])
    text = np.repeat(np.arange(len(c.ids)), c.counts)
    total = lambda x: np.bincount(text, x, len(c.ids))
    base = np.log10((known + 1) / (unigrams.n + unigrams.types + 1))
    columns = [
        pa.array(c.ids, pa.int64()),
        pa.array(c.held),
        pa.array(c.counts.astype(np.int64)),
        pa.array(total(known[c.word] > 0).astype(np.int64)),
        pa.array([unigrams.n] * len(c.ids), pa.int64()),
        pa.array(total(base[c.word])),
        pa.array(total(np.log10(np.maximum(p, 1e-300))[c.pair])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
