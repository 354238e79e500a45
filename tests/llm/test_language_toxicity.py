"""Learned scores: accuracy on rows that were held out, and the gradient."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from llm_cases import ODD, documents  # noqa: F401
from pyspark.sql import functions as F

from sift.llm import language, toxicity
from sift.llm.words import texts_of

SYLLABLES = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["kra", "sch", "ung", "pf"], "cc": ["éa", "ño", "ció", "lla"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_held_out_follows_the_checksum_of_the_id(spark):
    import zlib

    rows = spark.range(200).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_languages_of_rows_never_seen(spark):
    rng = random.Random(3)
    table = [(n, sentence(rng, lang, rng.randrange(3, 40)), lang) for n, lang in enumerate(rng.choices(sorted(SYLLABLES), k=300))]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string")
    odd = spark.createDataFrame([(1000 + n, t, None) for n, t in enumerate(ODD)] + [(None, "bami", None)], docs.schema)
    docs = docs.unionByName(odd)
    filters = language.learned(docs)
    assert filters.languages == sorted(SYLLABLES)
    found = {r.row.doc_id: r for r in language.identified(docs, filters).collect()}
    assert np.mean([found[n].lang_pred == lang for n, _, lang in table]) >= 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    letters = [any(c.isalpha() for c in t or "") for t in ODD]
    assert [found[1000 + n].lang_pred == "und" for n in range(len(ODD))] == [not has for has in letters]
    # No label is read to predict.
    bare = language.identified(docs.select("doc_id", "text"), filters).collect()
    assert {r.row.doc_id: r.lang_pred for r in bare} == {k: r.lang_pred for k, r in found.items()}


def test_more_languages_than_bits_of_a_word():
    rng = random.Random(1)
    own = {f"l{n:03}": ["".join(chr(0x4E00 + 20 * n + rng.randrange(20)) for _ in range(40)) for _ in range(5)] for n in range(70)}
    filters = language.learn({k: texts_of(pa.array(v)) for k, v in own.items()})
    best, _ = filters.predict(texts_of(pa.array([v[0] for v in own.values()])))
    assert best.tolist() == list(range(70)) and filters.bits.shape[1] == 2


def test_nothing_to_learn_from(spark, documents):
    docs = documents(*ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identified(docs, language.learned(docs)).collect()} == {"und"}
    assert language.identified(docs.limit(0), language.learned(docs)).count() == 0


def test_gradients_are_those_of_finite_differences():
    net = toxicity.Network(3)
    texts = texts_of(pa.array(["one two three four", "two five", "", "word " * 40]))
    inputs = toxicity.word_inputs(texts)
    rows, doc = toxicity.windows_of(inputs)
    label = (doc % 2).astype(np.float32)
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    grads, _ = net.gradients(inputs, rows, label)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        busy = np.argwhere(grads[name] != 0)
        for at in map(tuple, busy[rng.permutation(len(busy))[:3]]):
            before, losses = value[at], []
            for step in (1e-3, -1e-3):
                value[at] = before + step
                losses.append(net.gradients(inputs, rows, label)[1])
            value[at] = before
            assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][at]) < 2e-4 + 0.02 * abs(grads[name][at]), (name, at)


def test_windows_overlap_and_cover_every_word():
    sizes = [0, 1, 31, 32, 33, 48, 49, 200]
    inputs = toxicity.word_inputs(texts_of(pa.array([" ".join(f"w{k}" for k in range(n)) for n in sizes])))
    rows, doc = toxicity.windows_of(inputs)
    for i, n in enumerate(sizes):
        own = [r[r >= 0] for r in rows[doc == i]]
        assert set(np.concatenate(own)) == set(inputs.which[inputs.first[i] : inputs.first[i + 1]])
        assert len(own) == 1 + max(0, -(-(n - 32) // 16))


def test_toxic_words_anywhere_in_a_text(spark):
    rng = random.Random(8)
    bad = ["vile", "grotty", "scabby"]

    def text(toxic):
        words = sentence(rng, rng.choice(["aa", "cc"]), rng.randrange(20, 120)).split()
        for _ in range(len(words) // 15 + 1 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        return " ".join(words)

    table = [(n, text(n % 4 == 0), int(n % 4 == 0)) for n in range(500)]
    docs = spark.createDataFrame([(n, t) for n, t, _ in table] + [(1000 + n, t) for n, t in enumerate(ODD)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, y) for n, _, y in table] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    net = toxicity.learned(docs, labels)
    found = {r.row.doc_id: r.score for r in toxicity.scored(docs, net).collect()}
    import zlib

    unseen = [(n, y) for n, _, y in table if zlib.crc32(str(n).encode()) % 5 == 0]
    assert np.mean([(found[n] >= 0.5) == bool(y) for n, y in unseen]) >= 0.9
    assert all(0 <= s <= 1 for s in found.values()) and found[1001] < 0.5
    # A long clean text with toxic words at its very end.
    late = spark.createDataFrame([(1, sentence(rng, "aa", 3000)), (2, sentence(rng, "aa", 3000) + " vile grotty vile scabby")], docs.schema)
    scores = {r.row.doc_id: r.score for r in toxicity.scored(late, net).collect()}
    assert scores[2] > 0.5 > scores[1]


def test_labels_of_one_kind(spark, documents):
    docs = documents(*ODD)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r.score < 0.5 for r in toxicity.scored(docs, toxicity.learned(docs, none)).collect())
    assert toxicity.scored(documents(), toxicity.learned(docs, none)).count() == 0


def test_filters_are_those_of_all_texts_at_once(spark):
    """Counted by tasks and by language, the n-grams are those of the texts taken together; texts are learned whole."""
    rng = random.Random(5)
    table = [(n, sentence(rng, lang, rng.randrange(1, 60)), lang) for n, lang in enumerate(rng.choices(sorted(SYLLABLES), k=200))]
    table += [(900, "x " * 300_000 + "zzyzx " * 500, "aa"), (901, "123", "dd"), (902, "", "dd")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string").repartition(5)
    import zlib

    own = {}
    for n, text, lang in table:
        if zlib.crc32(str(n).encode()) % 5:
            own.setdefault(lang, []).append(text)
    expected, found = language.learn({k: texts_of(pa.array(v)) for k, v in own.items()}), language.learned(docs)
    assert found.languages == expected.languages and (found.bits == expected.bits).all() and (found.wrong == expected.wrong).all()
    # By plain counting: what is predicted is the language with most n-grams in its filter.
    for text in [t for _, t, _ in table[:40]]:
        best, score = found.predict(texts_of(pa.array([text])))
        grams = language.grams_of(texts_of(pa.array([text])))
        counts = sum(found.counts(h, first)[0] for h, first in grams)
        total = sum(len(h[: first[-1]]) for h, first in grams)
        share = np.maximum(counts - total * found.wrong, 0) / (1 - found.wrong) / max(1, total)
        assert not total or (best[0] == share.argmax() and abs(score[0] - min(1, share.max())) < 1e-12)


def test_a_sample_has_the_smallest_hashes_of_each_group(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") < 40, "rare").otherwise("cold").alias("lang"))
    found = language.sampled(rows.unionByName(rows.limit(500)), "lang", 100).collect()
    order = {g: [r.doc_id for r in rows.where(F.col("lang") == g).orderBy(F.xxhash64("doc_id")).limit(100).collect()] for g in ("hot", "rare", "cold")}
    for group, ids in order.items():
        assert [r.doc_id for r in sorted(found, key=lambda r: r["at"]) if r.lang == group] == ids
    assert len(order["rare"]) == 8


def test_texts_are_learned_whole_or_not_at_all(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((texts.end - texts.start, toxic)))
    monkeypatch.setattr(toxicity, "LONGEST_BYTES", 5000)
    monkeypatch.setattr(toxicity, "LEARNED_BYTES", 20_000)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), F.when(F.col("id") % 7 == 0, 6000).otherwise(1000).cast("int")).alias("text"))
    toxicity.learned(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    ((sizes, toxic),) = seen
    assert set(sizes.tolist()) == {1000} and 0 < toxic.sum() <= 20 and 0 < (~toxic).sum() <= 20


def test_remembered_words_change_no_score(monkeypatch):
    """Against the network that learns, over chunks that meet words again; also with a memory that fills up."""
    rng = random.Random(12)
    long = [" ".join(rng.choices(["vile", "über", "ab", "x1", "ß" * 40, "w" * 300, *(f"v{n}" for n in range(90))], k=rng.randrange(0, 150))) for _ in range(120)]
    texts = [*(t or "" for t in ODD), *long]
    net = toxicity.Network(3)
    found = {}
    for size, room in ((len(texts), 1 << 12), (7, 1 << 12), (7, 40)):
        monkeypatch.setattr(toxicity, "REMEMBERED", room)
        scorer, counted = toxicity.Scorer(net), []
        monkeypatch.setattr(net, "word_vectors", lambda inputs: counted.append(len(inputs.key)) or toxicity.Network.word_vectors(net, inputs))
        found[size, room] = np.concatenate([scorer.scores(texts_of(pa.array(texts[lo : lo + size]))) for lo in range(0, len(texts), size)])
        assert len(scorer.key) <= room and (np.diff(scorer.key.astype(object)) > 0).all()
        if room > 40:
            # No word is worked out twice.
            assert sum(counted) == len(scorer.key)
    inputs = toxicity.word_inputs(texts_of(pa.array(texts)))
    rows, doc = toxicity.windows_of(inputs)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, doc, net.window_logits(net.word_gates(net.word_vectors(inputs)), rows))
    expected = np.where(np.diff(inputs.first) > 0, toxicity._sigmoid(best), 0.0)
    for scores in found.values():
        assert np.abs(scores - expected).max() < 1e-6
