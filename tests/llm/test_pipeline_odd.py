"""Pipeline stages and long texts: nulls, repeats, empty tables, clashing columns, two megabytes in one row."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken
from llm_cases import ODD
from test_words import regular_words
from tokenizers import Tokenizer

import corpus_pipeline
from sift.llm import byte_bpe, decontam, importance, lexical, near_dedup, quality, secrets, token_files, tree_bpe
from sift.llm.words import texts_of

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, `row` string, n_words string, `a.b c` string"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghilmnoprstu", k=rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of every odd kind among sound ones, and an empty copy of all tables."""
    rng = random.Random(23)
    long = prose(rng, 300_000)
    sound = [(n, prose(rng, 60)) for n in range(40)]
    item = prose(rng, 15)
    rows = [*sound, sound[3], sound[3], (100, None), (101, ""), (None, None), (None, sound[5][1]), (102, long), (103, "x" * 2_000_000)]
    rows += [(200 + n, t) for n, t in enumerate(ODD)] + [(300, f"{prose(rng, 30)} {item}"), (301, f'{prose(rng, 40)} token = "abcdefghijkl0123"')]
    full = [(i, t, None, None, None if t is None else len(t), "k", None, "w", "d") for i, t in rows]
    folder = str(tmp_path_factory.mktemp("odd"))
    labels = [(n, n % 3 > 0) for n in range(40)] + [(None, True), (5, None), (999, True)]
    for name, data, schema in (
        ("documents", full, SCHEMA), ("labels", [(i, None if q is None else int(q), None) for i, q in labels], "doc_id bigint, quality int, toxic int"),
        ("benchmark", [(1, item), (2, None), (3, ""), (None, "...")], "item_id bigint, text string"),
    ):
        frame = spark.createDataFrame(data, schema)
        frame.write.parquet(f"{folder}/full/{name}.parquet")
        frame.limit(0).write.parquet(f"{folder}/empty/{name}.parquet")
    return folder, rows, long


def test_every_stage_takes_odd_rows(spark, tables):
    folder, rows, long = tables
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found[name] = stage(spark, docs, f"{folder}/full")
        assert found[name].schema.simpleString() == docs.schema.simpleString(), name
        assert {r["kept"] for r in found[name].collect()} == {"k"} and {r["a.b c"] for r in found[name].collect()} == {"d"}
    good = ids(found["quality_rules"])
    assert good.count(3) in (0, 3) and not {100, 101, 103, 200, 201} & set(good)
    unique = ids(found["near_duplicates"])
    assert unique.count(3) == 1 and {100, 101, 102, 103} <= set(unique) and unique.count(None) >= 1
    clean = ids(found["benchmark_decontamination"])
    assert sorted(clean, key=str) == sorted((i for i, _ in rows if i != 300), key=str)
    masked = {r.doc_id: r for r in found["secret_scan"].collect()}
    assert len(found["secret_scan"].collect()) == len(rows) and masked[100].text is None and masked[102].text == long
    assert "[secret]" in masked[301].text and masked[301].n_chars == len(masked[301].text)
    last = corpus_pipeline.byte_bpe_encoding(spark, docs, f"{folder}/full").collect()
    assert len(last) == len(rows) and all(r.round_trip for r in last) and [r.ids for r in last if r.doc_id == 100] == [[]]


def test_the_whole_pipeline_on_odd_rows_and_on_none(spark, tables):
    folder, rows, _ = tables
    found = corpus_pipeline.run(spark, f"{folder}/full").collect()
    assert found and all(r.round_trip for r in found) and not {100, 101, 103, 300} & {r.doc_id for r in found}
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


# ---- texts longer than a chunk, and words that long hashes must tell apart ------------


def test_two_megabytes_of_text_in_one_row(spark, tables):
    _, _, long = tables
    docs = spark.createDataFrame([(1, long), (2, "short one")], "doc_id bigint, text string")
    words = long.split()
    with open(corpus_pipeline.TOKENIZER, "rb") as f:
        raw = f.read()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(raw).whole, special_tokens={})
    assert {r.row.doc_id: r.ids for r in byte_bpe.encoded(docs, corpus_pipeline.TOKENIZER, ["doc_id"]).collect()}[1] == library.encode_ordinary(long)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids
    assert {r.row.doc_id: r.ids for r in tree_bpe.encoded(docs, path, ["doc_id"]).collect()}[1] == ids
    assert {r.doc_id: r.ids for r in token_files.round_trip(docs, path, 2).collect()}[1] == [*ids, 2]
    forest = quality.fitted(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert {r.row.doc_id: (r.n_words, r.word_chars) for r in quality.judged(docs, forest, ["doc_id"]).collect()}[1] == (len(words), sum(map(len, words)))
    item = spark.createDataFrame([(1, " ".join(words[-12:]))], "item_id bigint, text string")
    assert {r.row.doc_id: (r.n_words, r.n_hit) for r in decontam.contamination(docs, item, ["doc_id"]).collect()}[1] == (len(words), 12)
    assert {r.doc_id: r["rank"] for r in lexical.ranked(docs, item, 5).collect()} == {1: 1}
    assert {r.row.doc_id: r.n_features for r in importance.weighted(docs, item, ["doc_id"]).collect()} == {1: len(words), 2: 2}
    late = spark.createDataFrame([(1, long + ' password = "abcdefghijkl0"')], "doc_id bigint, text string")
    (row,) = secrets.secrets_in(late, ["doc_id"]).collect()
    assert [(s.kind, s.start) for s in row.spans if s.start >= len(long)] == [("assign", len(long) + 1)]
    twin = spark.createDataFrame([(1, long), (2, long + " and more"), (3, "something else")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(twin, 85).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("size", [1024, 4096])
def test_long_regular_words_are_told_apart(spark, size):
    one, two = regular_words(size)
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one}\n{two}")], "doc_id bigint, text string")
    texts = {1: one, 2: two, 3: f"{one}\n{two}"}
    with open(corpus_pipeline.TOKENIZER, "rb") as f:
        raw = f.read()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(raw).whole, special_tokens={})
    for r in byte_bpe.encoded(docs, corpus_pipeline.TOKENIZER, ["doc_id"]).collect():
        assert r.ids == library.encode_ordinary(texts[r.row.doc_id]) and bytes(r.decoded).decode() == texts[r.row.doc_id]
    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    for r in token_files.round_trip(docs, path, 2).collect():
        assert r.ids == [*known.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
    counts = quality.rule_counts(texts_of(byte_bpe.pa.array(list(texts.values()))))
    assert counts["n_dup_lines"].tolist() == [0, 0, 0]
    items = spark.createDataFrame([(7, two)], "item_id bigint, text string")
    assert {r.row.doc_id: r.n_hit for r in decontam.contamination(docs, items, ["doc_id"]).collect()} == {1: 0, 2: 1, 3: 1}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs.where("doc_id < 3"), 85).collect()} == {1: 1, 2: 2}
