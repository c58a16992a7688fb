import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeloom.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, docs, library, window):
    """Every document's pieces cover its ids once; every sequence is gapless, within the window."""
    texts = defaultdict(list)
    for d in docs:
        texts[d.doc_id].append(np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for k, own in pieces.items():
        assert sum(p.length for p in own) == sum(map(len, texts[k]))
        if len(texts[k]) == 1:
            ids = texts[k][0]
            assert sorted(range(len(ids))) == sorted(i for p in own for i in range(p.start, p.start + p.length))
            for p in own:
                assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= window and (at == window or not at & (at - 1))


@pytest.mark.parametrize("window", [8, 2048])
def test_hard_texts(hard, library, window):
    check(packing.pack(hard, PATH, window).collect(), hard.collect(), library, window)


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(packing.pack(docs, PATH).collect(), docs.collect(), library, 2048)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_tightest_window(lengths):
    """The tree takes the window that a plain search takes."""
    windows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in room if r >= lengths[i]]
        room.append(room.pop(room.index(min(fits))) - lengths[i]) if fits else room.append(32 - lengths[i])
    windows = packing.best_fit(lengths, 32)
    assert sorted(32 - sum(lengths[i] for i in w) for w in windows) == sorted(room)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))


def test_empty_table(empty):
    assert packing.pack(empty, PATH).count() == 0
