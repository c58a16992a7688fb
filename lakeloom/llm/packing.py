"""Best-fit decreasing packing of documents into token sequences.

Every partition packs its own documents, so nothing is shuffled. A document is its token ids and one end id. Documents
longer than a window are cut into full windows and a rest; the rests, longest first, go to the open window with the
tightest remaining capacity that still holds them, which a segment tree over capacities finds in log2(window) steps.
A partition's windows then stay as best fit made them, but for the emptiest: just enough of these are cut up to fill
what the others lack, and what is left of them fills full windows and last ones at powers of two, which need no padding.

Tokens: the normaliser and the splitter of the tokenizer file work on each word alone, so the ids of a unit of text
between single spaces are remembered and reused; units are encoded by the library.

Defined results: null text is the empty text (the end id alone); repeated rows are packed each; null doc_id stays null;
further columns are ignored; sequence_id is partition << 33 | number, so it repeats when a lost task runs again.

Memory: per partition, each document's rest (two bytes a token for vocabularies under 65,536) and the units remembered (emptied at MOST_UNITS).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lakeloom.llm.byte_bpe import batches
from lakeloom.llm.common import doc_text, ship

MOST_UNITS = 400_000
#: ASCII white space to spaces and A-Z to a-z, as the normaliser does itself; a run of marks between a letter and a
#: space is a word of its own. Both make fewer different units.
PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTERS = "a-zÀ-ÖØ-öø-ÿ"
MARK = re.compile(rf"(?<=[{LETTERS}])([.,;:!?#*$%&|<>]+) ")
#: Units of letters alone are one word each, so many go to the library in one text and its word ends part them again.
ONE_WORD, AT_ONCE = re.compile(f"[{LETTERS}]+").fullmatch, 2_000


class Tree:
    """Segment tree over remaining capacities: how many open windows have each."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity >= least of an open window, or -1."""
        i = self.leaves + least
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.count[2 * i])
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Windows (lists of item numbers) for items of at most a window, longest first; ties by number."""
    tree, open_at, windows = Tree(window), [[] for _ in range(window + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        capacity = tree.tightest(lengths[i])
        if capacity < 0:
            at, capacity = len(windows), window
            windows.append([])
        else:
            at = open_at[capacity].pop()
            tree.add(capacity, -1)
        windows[at].append(i)
        if left := capacity - lengths[i]:
            open_at[left].append(at)
            tree.add(left, 1)
    return windows


def plan(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items of any length."""
    pieces, rests, sequence = [], [], 0
    for i, n in enumerate(lengths):
        for start in range(0, n - window + 1, window):
            pieces.append((i, start, window, sequence, 0))
            sequence += 1
        if n % window:
            rests.append(i)
    # A window is done if it is full or at a power of two. The emptiest of the others are cut up to fill what the rest lack.
    windows = [[(rests[k], lengths[rests[k]] // window * window, lengths[rests[k]] % window) for k in members] for members in best_fit([lengths[i] % window for i in rests], window)]
    used = [sum(n for *_, n in own) for own in windows]
    lacking = sorted((w for w, n in enumerate(used) if n < window and n & (n - 1)), key=lambda w: (-used[w], w))
    gap, supply, loose = sum(window - used[w] for w in lacking), 0, []
    while supply < gap:
        w = lacking.pop()
        gap, supply = gap - window + used[w], supply + used[w]
        loose += windows[w]
        windows[w] = []
    for own in windows:
        offset = 0
        for i, start, n in own:
            pieces.append((i, start, n, sequence, offset))
            offset += n
        sequence += bool(own)
    number = {w: k for k, w in enumerate((w for w, own in enumerate(windows) if own), sequence - sum(map(bool, windows)))}
    rooms = iter([(number[w], used[w], window - used[w]) for w in lacking])
    at = offset = room = 0
    left = sum(n for *_, n in loose)
    for i, start, n in loose:
        while n:
            if not room:
                at, offset, room = next(rooms, (sequence, 0, 0))
                if not room:
                    room = window if left >= window else 1 << left.bit_length() - 1
                    sequence += 1
            take = min(n, room)
            pieces.append((i, start, take, at, offset))
            start, n, room, offset, left = start + take, n - take, room - take, offset + take, left - take
    return pieces


class Words:
    """The library's ids, remembered for units of text between single spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = False
        self.units: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.whole = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)").search

    def learn(self, new: set[str]) -> None:
        words = [u for u in new if ONE_WORD(u)]
        for start in range(0, len(words), AT_ONCE):
            part = words[start : start + AT_ONCE]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            data = ids.tobytes()
            self.units.update((u, data[i:j]) for u, i, j in zip(part, [0, *stops[:-1]], stops, strict=True))
        others = [u for u in new if not ONE_WORD(u)]
        for start in range(0, len(others), AT_ONCE):
            part = others[start : start + AT_ONCE]
            for u, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.units[u] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        open_texts: list[tuple[int, list[str]]] = []
        missing: set[str] = set()
        for t in texts:
            if self.whole(t):
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            units = MARK.sub(r" \1 ", t.encode().translate(PLAIN).decode()).split(" ")
            found = list(map(self.units.get, units))
            if None in found:
                missing.update(u for u, f in zip(units, found, strict=True) if f is None)
                open_texts.append((len(out), units))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if len(self.units) + len(missing) > MOST_UNITS:
            self.units.clear()
            missing = {u for _, units in open_texts for u in units}
        self.learn(missing)
        for i, units in open_texts:
            out[i] = b"".join(map(self.units.__getitem__, units))
        return out


_words: dict[str, Words] = {}


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    end = np.array([end_id], "<u4").tobytes()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = Words(path)
        words, base = _words[path], TaskContext.get().partitionId() << 33
        small = "<u2" if max(len(words.ends), end_id + 1) <= 1 << 16 else "<u4"
        doc_ids, lengths, kept = [], [], []
        full: list[tuple] = []
        sequence = 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for part in parts:
            rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            for some in batches(rows, 2 << 20):
                for (doc_id, _), ids in zip(some, words.encode([t for _, t in some]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n - window + 1, window):  # full windows leave at once
                        full.append((doc_id, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), n, base + sequence, 0))
                        sequence += 1
                    if n % window:
                        doc_ids.append(doc_id)
                        lengths.append(n)
                        kept.append(np.frombuffer(ids, "<u4")[n - n % window :].astype(small).tobytes())
                if full:
                    yield emit(full)
                    full.clear()
        rests = [n % window for n in lengths]
        out = []
        for i, start, n, own, offset in plan(rests, window):
            ids = np.frombuffer(kept[i], small)[start : start + n].astype("<u4")
            out.append((doc_ids[i], lengths[i] - rests[i] + start, n, zlib.crc32(ids.tobytes()), lengths[i], base + sequence + own, offset))
            if len(out) == 20_000:
                yield emit(out)
                out = []
        yield emit(out)

    ship(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, schema)
