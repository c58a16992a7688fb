"""Token counts from a compiled finite-state tokenizer.

Two deterministic machines are composed, and neither builds the tokens.

Splitter. The split pattern of byte-level BPE becomes a transducer over twelve character classes with thirteen states,
whose transitions say whether a word starts at this character or started at the one before (the pattern looks one
character ahead). A batch of texts is cut into chunks of CHUNK characters; every chunk is run from all thirteen states
at once, which gives its state map; the maps compose in a parallel prefix scan (log2 of the chunks rounds), which gives
each chunk's entry state and so, in a second run, all word starts.

Counter. A state holds, for each start from which a vocabulary token may still grow, the last token of the encoding up
to there and its token count against the present one; by the local validity of BPE (a sequence is an encoding if and
only if each two neighbours are), the last token after one more byte is the only one that ends here and may follow the
last token at its start. The transition's annotation is the change of the token count. The machine is compiled as its
transitions are met, into an open-addressing table that runs over all words of a batch in step; a text's count is the
sum over its words.

Defined results: null text is the empty text (0 bytes, 0 tokens); repeated rows give repeated result rows; null doc_id
stays null; further columns are ignored. Special strings in a text are one token each, as the library does by default.

Memory: one batch of BATCH_CHARS characters (one longer text alone), and the table, dropped at MOST_STATES states.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeloom.llm.byte_bpe import batches
from lakeloom.llm.common import doc_text, ship

CHUNK, BATCH_CHARS, MOST_STATES = 256, 2 << 20, 600_000
#: Words over so many bytes run alone, by the same table.
LONG_WORD = 512
#: Lone surrogates, which no text holds: a text's end and a special token.
END, SPECIAL = "\udcff", "\udcfe"

# Character classes.
LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER, STMD, R, V, E, ELL, STOP = range(12)
# States: nothing open, runs, an open quote and quote + r/v/l, a full contraction, white runs of one and more.
FRESH, LETTERS, NUMBERS, OTHERS, QUOTED, QR, QV, QL, DONE, SPACE1, WHITE1, SPACES, WHITES = range(13)
LETTER_CLASSES = (LETTER, STMD, R, V, E, ELL)
HERE, BEFORE = 1, 2


def _fresh(c: int) -> int:
    return {NUMBER: NUMBERS, SPACE: SPACE1, WHITE: WHITE1, QUOTE: QUOTED, OTHER: OTHERS, STOP: FRESH}.get(c, LETTERS)


def _move(s: int, c: int) -> tuple[int, int]:
    """(state, marks) after a character of class c."""
    if c == STOP:
        return FRESH, HERE | (BEFORE if s in (QR, QV, QL) else 0)
    if s in (FRESH, DONE):
        return _fresh(c), HERE
    if s == LETTERS:
        return (LETTERS, 0) if c in LETTER_CLASSES else (_fresh(c), HERE)
    if s == NUMBERS:
        return (NUMBERS, 0) if c == NUMBER else (_fresh(c), HERE)
    if s == OTHERS:
        return (OTHERS, 0) if c in (OTHER, QUOTE) else (_fresh(c), HERE)
    if s == QUOTED:
        if c in (STMD, R, V, ELL):
            return {STMD: DONE, R: QR, V: QV, ELL: QL}[c], 0
        return (OTHERS, 0) if c in (OTHER, QUOTE) else (_fresh(c), HERE)
    if s in (QR, QV, QL):
        if c == (ELL if s == QL else E):
            return DONE, 0
        state, marks = _move(LETTERS, c)
        return state, marks | BEFORE
    if c in (SPACE, WHITE):
        return (SPACES if c == SPACE else WHITES), 0
    again = BEFORE if s in (SPACES, WHITES) else 0
    if s in (WHITE1, WHITES):
        return _fresh(c), HERE | again
    return (OTHERS if c == QUOTE else _fresh(c)), again


MOVES = np.array([[_move(s, c)[0] for c in range(12)] for s in range(13)], np.int8)
MARKS = np.array([[_move(s, c)[1] for c in range(12)] for s in range(13)], np.int8)


def class_table() -> np.ndarray:
    """Class of each code point; the sets are those of \\p{L}, \\p{N} and \\s."""
    import regex

    out = np.full(0x110000, OTHER, np.int8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, points):
            shift = [0x800 * (i >= 0xD800) for i in (m.start(), m.end() - 1)]
            out[m.start() + shift[0] : m.end() + shift[1]] = kind
    out[[ord(c) for c in "stmd"]] = STMD
    for c, kind in ((" ", SPACE), ("'", QUOTE), ("r", R), ("v", V), ("e", E), ("l", ELL), (END, STOP), (SPECIAL, STOP)):
        out[ord(c)] = kind
    return out


def entry_states(classes: np.ndarray) -> np.ndarray:
    """Entry state of each row (chunk) of classes, the first entered FRESH."""
    n = len(classes)
    maps = np.repeat(np.arange(13, dtype=np.int8)[None, :], n, 0)
    for j in range(classes.shape[1]):
        maps = MOVES[maps, classes[:, j : j + 1]]
    step = 1
    while step < n:  # inclusive scan: after it, maps[i] composes chunks 0..i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    return np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.int8)


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Positions at which words start; classes end with STOP."""
    n = len(classes)
    rows = np.concatenate([classes, np.full(-n % CHUNK, STOP, np.int8)]).reshape(-1, CHUNK)
    state, marks = entry_states(rows), np.empty(rows.shape, np.int8)
    for j in range(CHUNK):
        c = rows[:, j]
        marks[:, j] = MARKS[state, c]
        state = MOVES[state, c]
    flat = marks.reshape(-1)[:n]
    starts = (flat & HERE).astype(bool)
    starts[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(starts)


class Counter:
    """The compiled counting transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.bytes = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items() if t not in self.specials}
        self.ids = {b: i for i, b in self.bytes.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(model["vocab"][a], model["vocab"][b]): (k, model["vocab"][a + b]) for k, (a, b) in enumerate(merges)}
        self.child: dict[int, int] = {}
        self.token, self.grows = [-1], [True]
        for i, b in self.bytes.items():
            node = 0
            for x in b:
                self.grows[node] = True
                if (to := self.child.get(node << 8 | x)) is None:
                    to = self.child[node << 8 | x] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
                node = to
            self.token[node] = i
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.size = 1 << 16
        self.used = 0
        self.keys, self.to, self.delta = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32), np.zeros(self.size, np.int16)

    def encode(self, data: bytes) -> list[int]:
        """Merges by rank, for the test whether two tokens may be neighbours."""
        out = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(out) > 1:
            found = min((self.merges[p][0], i) if (p := (out[i], out[i + 1])) in self.merges else (1 << 40, i) for i in range(len(out) - 1))
            if found[0] == 1 << 40:
                break
            i = found[1]
            out[i : i + 2] = [self.merges[out[i], out[i + 1]][1]]
        return out

    def may_follow(self, last: int, token: int) -> bool:
        key = (last, token)
        if (known := self.follows.get(key)) is None:
            data = self.bytes[token]
            known = self.encode(data) == [token] if last < 0 else self.may_follow(-1, token) and self.encode(self.bytes[last] + data) == [last, token]
            self.follows[key] = known
        return known

    def compile(self, key: int) -> tuple[int, int]:
        """(next state, change of the count) for state << 8 | byte."""
        state, byte = self.states[key >> 8], key & 255
        kept, found = [], None
        for node, last, count in state:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            t = self.token[to]
            if t >= 0 and found is None and self.may_follow(last, t):
                found = (t, count + 1)
            if self.grows[to]:
                kept.append((to, last, count))
        token, delta = found
        new = (*((n, last, c - delta) for n, last, c in kept), (0, token, 0))
        if (number := self.number.get(new)) is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        return number, delta

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the table, or of the free slot where it belongs."""
        mask = self.size - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & mask
        there = self.keys[at]
        wrong = np.flatnonzero((there != keys) & (there != -1))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            there = self.keys[at[wrong]]
            wrong = wrong[(there != keys[wrong]) & (there != -1)]
        return at

    def insert(self, keys: np.ndarray, to: np.ndarray, delta: np.ndarray) -> None:
        if (self.used + len(keys)) * 3 > self.size:
            full = self.keys >= 0
            old = self.keys[full], self.to[full], self.delta[full]
            while (self.used + len(keys)) * 3 > self.size:
                self.size *= 2
            self.used = 0
            self.keys, self.to, self.delta = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32), np.zeros(self.size, np.int16)
            self.insert(*old)
        self.used += len(keys)
        while len(keys):  # keys that want one slot take it in turn
            at = self.slots(keys)
            slot, first = np.unique(at, return_index=True)
            self.keys[slot], self.to[slot], self.delta[slot] = keys[first], to[first], delta[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, delta = keys[rest], to[rest], delta[rest]

    def advance(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the transitions, compiled where they are new."""
        at = self.slots(keys)
        missing = np.unique(keys[self.keys[at] < 0])
        if len(missing):
            made = [self.compile(k) for k in missing.tolist()]
            self.insert(missing, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int16))
            at = self.slots(keys)
        return at

    def count(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word data[begin : begin + length]."""
        if len(self.states) > MOST_STATES:
            self.reset()
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        total, state = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        ends = np.cumsum(np.bincount(length, minlength=2)[::-1])[::-1]  # words of this length or more
        for j in range(min(int(length[0]) if len(length) else 0, LONG_WORD)):
            n = int(ends[j + 1])
            at = self.advance(state[:n] << 8 | data[begin[:n] + j])
            state[:n] = self.to[at]
            total[:n] += self.delta[at]
        for i in range(int(ends[LONG_WORD + 1]) if len(ends) > LONG_WORD + 1 else 0):
            s, n, seen = int(state[i]), 0, {}
            for b in data[begin[i] + LONG_WORD : begin[i] + length[i]].tolist():
                k = s << 8 | b
                if (m := seen.get(k)) is None:
                    m = seen[k] = self.compile(k)
                s, n = m[0], n + m[1]
            total[i] += n
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


_made: dict[str, tuple[Counter, np.ndarray]] = {}


def machine(path: str) -> tuple[Counter, np.ndarray]:
    if path not in _made:
        _made[path] = Counter(path), class_table()
    return _made[path]


def count_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text."""
    counter, table = machine(path)
    n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
    for s in counter.specials:
        texts = [t.replace(s, SPECIAL) if s in t else t for t in texts]
    joined = END.join(texts) + END
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    place = np.cumsum(width, dtype=np.int64) - width
    starts = word_starts(table[points])
    begin = place[starts]
    length = np.diff(np.append(begin, len(data)))
    first = points[starts]
    text = np.cumsum(first == ord(END)) - (first == ord(END))
    word = (first != ord(END)) & (first != ord(SPECIAL))
    tokens = np.zeros(len(starts), np.int64)
    tokens[first == ord(SPECIAL)] = 1
    tokens[word] = counter.count(data, begin[word], length[word])
    return n_bytes, np.bincount(text, tokens, len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            for some in batches(rows, BATCH_CHARS):
                n_bytes, n = count_texts([t for _, t in some], path)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ship(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
