import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeloom.llm import token_count

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_hard_texts(hard, library):
    rows = token_count.token_counts(hard, PATH, 100).collect()
    texts = {r.doc_id: r.text or "" for r in hard.collect()}
    assert len(rows) == hard.count()
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 100), r.doc_id


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abstmdrvel''  \n\t19!.é漢\xa0", "<|endoftext|>"]), max_size=60).map("".join), max_size=4))
def test_any_text(texts):
    lib = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = lib
    if texts:
        assert token_count.count_texts(texts, PATH)[1].tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text or "" for r in docs.collect()]
    assert sorted(r.n_tokens for r in token_count.token_counts(docs, PATH, 1024).collect()) == sorted(len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False))


def test_empty_table(empty):
    assert token_count.token_counts(empty, PATH, 1).count() == 0
