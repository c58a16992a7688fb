import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from lakeloom.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(rows, texts, library):
    for r in rows:
        text = texts[r.doc_id]
        ids = library.encode_ordinary(text)
        assert r.ids == ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_hard_texts(hard, library):
    rows = byte_bpe.encode(hard, PATH, P.PATTERN).collect()
    assert len(rows) == hard.count()
    texts = {r.doc_id: r.text or "" for r in hard.collect()}
    check(rows, texts, library)


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    check(byte_bpe.encode(docs, PATH, P.PATTERN).collect(), texts, library)


def test_empty_table(empty):
    assert byte_bpe.encode(empty, PATH, P.PATTERN).count() == 0


def test_letters_are_one_pretoken():
    own = byte_bpe.codec(PATH, P.PATTERN)
    for unit in (f"{space}{chr(c)}" for c in range(0x110000) if chr(c).isalpha() for space in ("", " ")):
        assert own.is_word(unit) and own.split(unit) == [unit]
    assert not any(map(own.is_word, ("", " ", "a b", "a1", "'s", "  a")))
