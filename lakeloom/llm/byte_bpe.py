"""Byte-level BPE encoding and decoding as DuckDB recursive queries inside each partition.

Encoding. A text falls into pretokens by the split pattern; each distinct pretoken of a partition is a word with one
row for each token position. The recursive member joins the positions of a word with the merge table (left, right ->
rank), finds the word's leftmost pair of the least rank and contracts it; words without such a pair leave the
recursion, so it ends at the fixpoint. Decoding joins (sequence, position, id) rows with the vocabulary and aggregates
the bytes in the order of positions.

Defined results: null text is the empty text, which has no tokens; repeated rows give repeated result rows; null
doc_id stays null; further columns of the input are ignored. A pretoken over LONG_WORD bytes takes the same contraction
rule with a heap over a linked list (the recursion needs a pass over the word for each merge, the heap doesn't).

Memory: a worker keeps the words it has met in a dictionary, emptied at CACHE_WORDS; texts are held for one Arrow batch.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeloom.llm.common import doc_text, ship

#: Pretokens over so many bytes are contracted with a heap.
LONG_WORD = 256
#: Words for one recursive query, and words that a worker remembers.
QUERY_WORDS, CACHE_WORDS = 40_000, 1_000_000
#: Characters that \s matches in the split pattern (Unicode White_Space).
WHITE = frozenset(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: A position's key k is word << 10 | place; n is the key of the next position and u its token, so pairs need no join of
#: positions. The least rank << 20 | place of a word is its leftmost pair of the least rank; only the position that this
#: pair swallows is looked up, for its n and u.
ENCODE = """
CREATE OR REPLACE TEMP TABLE sequences AS
WITH RECURSIVE step(it, w, k, n, t, u) AS (
    SELECT 0::INT, w, (w::BIGINT << 10) | p, (w::BIGINT << 10) | (p + 1), t, u FROM symbols
    UNION ALL
    (WITH pairs AS (
        SELECT w, (rank::BIGINT << 20) | (k & 1023) AS best, n FROM step JOIN merges ON pair = ((t::BIGINT << 24) | u)
    ), least AS MATERIALIZED (
        SELECT w, min(best) AS best, arg_min(n, best) AS gone FROM pairs GROUP BY w
    ), picks AS MATERIALIZED (
        SELECT least.w, (least.w::BIGINT << 10) | (best & 1023) AS kept, (best >> 20)::INT AS made, gone, n AS n_gone, u AS u_gone
        FROM least JOIN step ON k = gone
    )
    SELECT it + 1, w, k,
        CASE WHEN k = kept THEN n_gone ELSE n END,
        CASE WHEN k = kept THEN made ELSE t END,
        CASE WHEN k = kept THEN u_gone WHEN n = kept THEN made ELSE u END
    FROM step JOIN picks USING (w) WHERE k <> gone)
), last AS (SELECT w, max(it) AS it FROM step GROUP BY w)
SELECT w, k, t FROM step JOIN last USING (w, it)
"""

#: The ids as decimal text, and the bytes they stand for.
DECODE = """
SELECT w, array_to_string(list(t ORDER BY k), ',') AS ids, unhex(array_to_string(list(hex ORDER BY k), '')) AS bytes
FROM sequences JOIN vocabulary USING (t) GROUP BY w
"""


class Codec:
    """Ranks, split pattern and the DuckDB tables made from them; one for each worker process and vocabulary."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {k: t for t, k in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        # Whether a run of letters, with or without a space before it, is always one pretoken.
        first, found, _ = pattern.partition(r"| ?\p{L}+|")
        self.letters = bool(found) and all(a.startswith("'") for a in first.split("|"))
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs, rank = [], []
        for token, k in self.ranks.items():
            for i in range(1, len(token)):
                left = self.ranks.get(token[:i])
                right = self.ranks.get(token[i:]) if left is not None else None
                if right is not None:
                    pairs.append((left << 24) | right)
                    rank.append(k)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(rank, pa.int32())})
        vocabulary = pa.table({"t": pa.array(self.tokens, pa.int32()), "hex": pa.array([b.hex() for b in self.tokens.values()], pa.string())})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def code(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        """(ids as decimal text, decoded bytes) of each word (a pretoken's bytes)."""
        out: list = [None] * len(words)
        todo = []
        for i, w in enumerate(words):
            if (k := self.ranks.get(w)) is not None:
                out[i] = (str(k), self.tokens[k])
            elif len(w) > LONG_WORD:
                ids = self.heap_encode(w)
                out[i] = (",".join(map(str, ids)), b"".join([self.tokens[t] for t in ids]))
            elif w:
                todo.append(i)
            else:
                out[i] = ("", b"")
        for start in range(0, len(todo), QUERY_WORDS):
            part = todo[start : start + QUERY_WORDS]
            lengths = np.array([len(words[i]) for i in part])
            data = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
            ends = np.cumsum(lengths)
            places = (np.arange(len(data)) - np.repeat(ends - lengths, lengths)).astype(np.int32)
            tokens = self.byte_ids[data]
            following = np.append(tokens[1:], np.int32(-1))
            following[ends - 1] = -1
            symbols = pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), lengths), "p": places, "t": tokens, "u": following})
            self.db.register("symbols", symbols)
            try:
                self.db.execute(ENCODE)
                found = self.db.sql(DECODE).to_arrow_table()
            finally:
                self.db.unregister("symbols")
            for w, *both in zip(*(c.to_pylist() for c in found.columns), strict=True):
                out[part[w]] = tuple(both)
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        return [numbers(ids) for ids, _ in self.code(words)]

    def heap_encode(self, word: bytes) -> list[int]:
        """The same contraction for one long word, in n log n."""
        token = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        alive = [True] * len(word)
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(word) and (k := self.ranks.get(token[i] + token[j])) is not None:
                heapq.heappush(heap, (k, i, len(token[i]), len(token[j])))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else len(word)
            if j >= len(word) or len(token[i]) != a or len(token[j]) != b:
                continue
            token[i] += token[j]
            alive[j] = False
            after[i] = after[j]
            if after[j] < len(word):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[t] for t, live in zip(token, alive, strict=True) if live]

    def is_word(self, unit: str) -> bool:
        """Whether the unit is one pretoken of letters (what str.isalpha takes, the pattern's \\p{L} takes too)."""
        return self.letters and (unit[1:].isalpha() if unit[:1] == " " else unit.isalpha())

    def pieces(self, text: str) -> list[str]:
        """Units that split alike alone and in the text: it is cut before each space that a non-white character follows."""
        first, *rest = text.split(" ")
        if "" not in rest and not any(u[0] in WHITE for u in rest):
            return [first, *[" " + u for u in rest]] if first else [" " + u for u in rest]
        return self.split(text)


def numbers(ids: str) -> list[int]:
    return [int(t) for t in ids.split(",")] if ids else []


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


class Cache:
    """unit -> (its ids as decimal text, decoded bytes), for all units of a batch at a time."""

    def __init__(self, own: Codec):
        self.own, self.units = own, {}

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.units]
        if len(self.units) + len(new) > CACHE_WORDS:
            self.units, new = {}, list(units)
        whole, mixed = [], {}
        for u in new:
            if self.own.is_word(u):
                whole.append(u)
            else:
                mixed[u] = self.own.split(u)
        words = list({w for p in mixed.values() for w in p}.difference(whole))
        coded = self.own.code([w.encode() for w in (*whole, *words)])
        self.units.update(zip(whole, coded))
        if mixed:
            of_word = dict(zip((*whole, *words), coded, strict=True))
            for u, p in mixed.items():
                ids, plain = zip(*[of_word[w] for w in p], strict=True) if p else ((), ())
                self.units[u] = (",".join(ids), b"".join(plain))


_caches: dict[tuple[str, str], Cache] = {}


def batches(rows: list, most: int = 8 << 20) -> Iterator[list]:
    """Runs of rows with about so many characters of text at most."""
    run, size = [], 0
    for r in rows:
        run.append(r)
        size += len(r[1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (with_ids) the ids, of each row's text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        cache = _caches.setdefault((path, pattern), Cache(own))
        gc.disable()  # units and their ids have no cycles, and passes over all of them take a fifth of the time
        try:
            for part in parts:
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                for some in batches(rows):
                    units = [own.pieces(text) for _, text in some]
                    cache.learn(set().union(*units))
                    n, ids, plain, lists = [], [], [], []
                    for us in units:
                        decimal, decoded = zip(*map(cache.units.__getitem__, us), strict=True) if us else ((), ())
                        sequence = ",".join(filter(None, decimal))
                        n.append(sequence.count(",") + bool(sequence))
                        ids.append(hashlib.sha256(sequence.encode()).hexdigest())
                        plain.append(hashlib.sha256(b"".join(decoded)).hexdigest())
                        if with_ids:
                            lists.append(numbers(sequence))
                    columns = [pa.array([i for i, _ in some], pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        columns.append(pa.array(lists, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            gc.enable()

    ship(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, schema)
