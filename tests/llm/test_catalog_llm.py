"""The registered queries on the smallest tables, and the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from test_near_dedup import brute_force as classes
from test_decontam import brute_force as hits
from tokenizers import Tokenizer

import corpus_pipeline
from sift.llm import byte_bpe, catalog, quality, secrets
from tools.compare import compare, connect


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_small, name):
    outcome = compare(spark, connect(sf_small), name, sf_small)
    assert outcome.startswith("ok"), outcome


COLUMNS = {
    "op1_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_html_text": ["page_id", "url", "text", "n_chars"],
    "op5_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op13_tree_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_other_queries_cover_their_table(spark, sf_small, name):
    found = catalog.queries()[name](spark, sf_small)
    assert found.columns == COLUMNS[name]
    table = "pages" if name == "op4_html_text" else "documents"
    assert found.count() == spark.read.parquet(f"{sf_small}/{table}.parquet").count()


def test_digests_of_secrets_and_ids(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    with open(corpus_pipeline.TOKENIZER, "rb") as f:
        ranks = byte_bpe.parse_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks.whole, special_tokens={})
    sha = lambda text: hashlib.sha256(text).hexdigest()
    for r in catalog.op5_byte_bpe(spark, sf_small).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode())) and r.decoded_sha256 == sha(texts[r.doc_id].encode())
    for r in catalog.op3_secret_scan(spark, sf_small).collect():
        spans = [f"{k}:{s}:{e}" for k, s, e in secrets.find_secrets(texts[r.doc_id])]
        base = [s for s in spans if s.split(":")[0] in secrets.BASE_KINDS]
        assert r.spans == ",".join(spans) and r.base_sha256 == sha(",".join(base).encode())


def test_digests_of_words_with_ends(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for r in catalog.op13_tree_bpe(spark, sf_small).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_pipeline_against_plain_python(spark, sf_small):
    """Every stage again without Spark; only the forest's verdicts are taken from it."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    forest = quality.fitted(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    good = {r.row.doc_id for r in quality.judged(docs, forest, ["doc_id"]).where("kept").collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    kept = {row[0] for row in classes(left, corpus_pipeline.SIMILARITY) if row[3]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    left = {i: t for i, t in left if i in kept and not hits(t, items)[1]}
    with open(corpus_pipeline.TOKENIZER, "rb") as f:
        ranks = byte_bpe.parse_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks.whole, special_tokens={})
    expected = {i: library.encode_ordinary(secrets.masked(t, secrets.find_secrets(t))) for i, t in left.items()}
    found = corpus_pipeline.run(spark, sf_small).collect()
    assert {r.doc_id: r.ids for r in found} == expected and len(found) == len(expected) > 50
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)


def test_stages_return_the_columns_of_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_small).schema.simpleString() == docs.schema.simpleString()
    masked = corpus_pipeline.secret_scan(spark, docs, sf_small).where("text like '%[secret]%'").collect()
    assert masked and all(r.n_chars == len(r.text) and not re.search("(?i)token *= *[\"']?[a-z0-9]{12}", r.text) for r in masked)
