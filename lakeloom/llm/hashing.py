"""64-bit hashes of words and word shingles, for whole batches of texts at a time."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x9E3779B97F4A7C15D1B54A32D192ED03 & MASK | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        top = np.uint64(int(_powers[-1]) * STEP & MASK)
        _powers = np.concatenate([_powers, _powers * top])
    return _powers


def word_hashes(texts: list[str], most_bytes: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text): A-Z count as a-z, words end at the six ASCII white-space characters."""
    hashes, counts = [], []
    start = 0
    encoded = [t.encode() for t in texts]
    while start < len(encoded):
        end, size = start, 0
        while end < len(encoded) and (size == 0 or size + len(encoded[end]) < most_bytes):
            size += len(encoded[end]) + 1
            end += 1
        h, c = _some(encoded[start:end])
        hashes.append(h)
        counts.append(c)
        start = end
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def _some(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(encoded) + b"\n", np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    bounds = np.cumsum([1, *[len(e) + 1 for e in encoded]])
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    inside = np.flatnonzero(~space)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    values = BYTE_VALUES[LOWER[data[inside]]] * powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), counts


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; under width words the whole sequence is one, none without words."""
    words, counts = word_hashes(texts)
    n = len(words)
    rolled = np.full(max(0, n - width + 1), np.uint64(width), np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(0xFF51AFD7ED558CCD) + words[k : k + len(rolled)])
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            one = np.array([c], np.uint64)
            for k in range(c):
                one = mix(one * np.uint64(0xFF51AFD7ED558CCD) + words[at + k : at + k + 1])
            out.append(one)
        else:
            out.append(words[:0])
        at += c
    return out
