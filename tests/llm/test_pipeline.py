import corpus_pipeline as pipeline
import public_tokenizers as P
from tokenizers import Tokenizer

from lakeloom.llm import quality, toxicity
from tests.llm.test_jaccard_join import plain as components
from tests.llm.test_packing import check as check_packing
from tests.llm.test_quality import plain as measures
from tests.llm.test_secrets import base


def test_against_plain_stages(spark, sf):
    """Each stage against a plain version of it, on what the stage before it kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert not quality.certify(quality.measure(docs), labels).collect()  # too few labels here: base rules alone
    want = {i: t for i, t in kept.items() if not measures(t)[5]}
    first = pipeline.quality_rules(spark, docs, sf)
    assert {r.doc_id: r.text for r in first.collect()} == want and first.columns == docs.columns
    grammar = toxicity.fit(first, labels)
    want = {i: t for i, t in want.items() if grammar.score(grammar.features(t)) < 0.5}
    second = pipeline.toxic(spark, first, sf).cache()
    assert {r.doc_id: r.text for r in second.collect()} == want
    want = {i: want[i] for i, n, c in components(sorted(want.items()), 5, 80) if n == 0 or c == i}
    third = pipeline.near_duplicates(spark, second, sf).cache()
    assert {r.doc_id: r.text for r in third.collect()} == want
    fourth = pipeline.secret_scan(spark, third, sf).cache()
    rows = {r.doc_id: r for r in fourth.collect()}
    assert rows.keys() == want.keys() and fourth.columns == docs.columns
    assert all((r.text == want[i]) == (not base(want[i])) and r.n_chars == len(r.text) and not base(r.text) for i, r in rows.items())
    check_packing(pipeline.packed(spark, fourth, sf).collect(), list(rows.values()), Tokenizer.from_file(P.path("word_bpe_49k.json")), 2048)
