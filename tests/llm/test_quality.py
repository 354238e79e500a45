"""The isolation forest: what it rejects, and that a document's fate is its own."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD, documents  # noqa: F401
from pyspark.sql import functions as F

from sift.llm import quality
from sift.llm.words import texts_of


def prose(rng, n=80):
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou') * rng.randrange(1, 4)}{rng.randrange(50)}" for _ in range(n)) + "."


def junk(rng, n=80):
    return " ".join(f"{w}{rng.choice(['###', '***', '&&&', '|'])}" for w in prose(rng, n).split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [(prose if n % 8 else junk)(rng, rng.randrange(40, 150)) for n in range(400)]
    return texts, [int(n % 8 > 0) for n in range(400)]


def test_rejects_junk_and_keeps_prose(spark, documents, corpus):
    texts, good = corpus
    labels = spark.createDataFrame([(n, q) for n, q in enumerate(good) if n < 300] + [(None, 1), (3, None), (9999, 0)], "doc_id bigint, quality int")
    docs = documents(*texts, *[(1000 + n, t) for n, t in enumerate(ODD)])
    forest = quality.fitted(docs, labels)
    found = {r.row.doc_id: r for r in quality.judged(docs, forest).collect()}
    unseen = range(300, 400)
    assert np.mean([found[n].kept == bool(good[n]) for n in unseen]) >= 0.95
    assert not any(found[1000 + n].kept for n, t in enumerate(ODD) if not (t or "").strip())
    assert found[1000].n_words == 0 and found[1000].base_failed
    # The verdict is the same whatever else is in the table.
    alone = quality.judged(docs.where("doc_id = 17"), forest).first()
    assert alone == found[17]


def test_without_labels_only_the_base_rules_reject(spark, documents, corpus):
    docs = documents(*corpus[0][:20])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.judged(docs, quality.fitted(docs, none)).where("kept").count() == 20
    assert quality.judged(documents(), quality.fitted(documents(), none)).count() == 0


def test_paths_are_shorter_for_outliers():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (300, 3)), [[3, 3, 3]]])
    forest = quality.grow(x[:-1], x.min(axis=0), x.max(axis=0))
    path = forest.mean_path(x)
    assert path[-1] < path[:-1].min() and (forest.anomaly(x)[-1] > forest.anomaly(x)[:-1]).all()


def test_all_labelled_rows_count(spark):
    """Ten thousand labelled rows: the rejected ones come last by the hash that once drew a sample of 8,192."""
    rng = random.Random(3)
    ids = [r[0] for r in spark.range(10_000).orderBy(F.xxhash64("id")).collect()]
    junky = set(ids[-40:])
    rows = [(n, (junk if n in junky else prose)(rng, 24), int(n not in junky)) for n in ids]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").repartition(5)
    forest = quality.fitted(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    found = {r.row.doc_id: r.kept for r in quality.judged(table, forest, ["doc_id"]).collect()}
    assert not any(found[n] for n in junky)
    assert sum(not found[n] for n in ids if n not in junky) <= 2 * quality.FALSE_REJECTS * len(ids)


def test_tasks_grow_the_forest_of_all_rows(spark, corpus):
    texts, good = corpus
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame(list(enumerate(good)), "doc_id bigint, quality int")
    forest = quality.fitted(docs.repartition(7), labels)
    half = {r.doc_id: r.fit for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("fit")).collect()}
    x = quality.features(quality.rule_counts(texts_of(pa.array(texts))))
    fit, good = np.array([half[n] for n in range(len(texts))]), np.array(good, dtype=bool)
    whole = quality.grow(x[fit & good], x[fit].min(axis=0), x[fit].max(axis=0))
    for name in ("feature", "split", "left", "path"):
        assert (getattr(forest, name) == getattr(whole, name)).all()
    path = whole.mean_path(x)
    safe = np.sort(path[~fit & good])
    limit = safe[int(quality.FALSE_REJECTS * len(safe))]
    assert forest.threshold == (limit + path[~fit & ~good & (path < limit)].max()) / 2


def test_paths_are_means_over_draws(monkeypatch):
    """Against trees grown over drawn rows, split by split."""
    monkeypatch.setattr(quality, "TREES", 2)
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (400, 2)) ** 3
    trees = quality.drawn(x.min(axis=0), x.max(axis=0))
    found = quality.pruned(trees, trees.leaves(x)).mean_path(x)
    nodes = [[[0] for _ in x] for _ in range(2)]
    for t in range(2):
        for own, row in zip(nodes[t], x):
            for _ in range(quality.DEPTH):
                own.append(2 * own[-1] + 1 + int(row[trees.feature[t, own[-1]]] >= trees.split[t, own[-1]]))
    nodes = np.array(nodes)
    total = np.zeros(len(x))
    for _ in range(500):
        some = rng.choice(len(x), quality.TREE_ROWS, replace=False)
        for t in range(2):
            held = np.bincount(nodes[t][some].ravel(), minlength=2 << quality.DEPTH)[nodes[t]]
            total += (held[:, :-1] >= 2).sum(axis=1) + np.array([quality._expected(n) for n in held[:, -1]])
    assert np.abs(total / 1000 - found).max() < 0.4
