"""Importance resampling: CRCs of n-grams, gains, noise and ranks by their definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD, documents  # noqa: F401
from test_words import regular_words

from sift.llm import importance
from sift.llm.words import texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, most):
    own = words(text)
    return [" ".join(own[k : k + n]) for n in range(1, most + 1) for k in range(len(own) - n + 1)]


def buckets_of(text, most, buckets):
    return Counter(zlib.crc32(g.encode()) % buckets for g in grams(text, most))


@pytest.mark.parametrize("most", [1, 3])
def test_crcs_of_all_ngrams(most):
    rng = random.Random(most)
    parts = ["a", "The", "é", "中文", " ", "  ", ",", "-", "0", "😀", "\x00", "z" * 70, "q" * 200]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(300)] + ODD + [" ".join(regular_words(4096)), "y" * 300_000 + " end"]
    found = importance.features(texts_of(pa.array(texts, pa.string())), most, 9973)
    for n, text in enumerate(texts):
        assert Counter(found.bucket[found.text == n].tolist()) == buckets_of(text, most, 9973), text
    assert found.n_words.tolist() == [len(words(t)) for t in texts]


def test_registers_after_every_prefix():
    data = np.frombuffer(random.Random(1).randbytes(5 * importance.LANE + 3), dtype=np.uint8)
    crc = importance.running_crc(data)
    for n in range(len(data) + 1):
        moved = importance.shifted(np.array([0xFFFFFFFF], dtype=np.uint32), np.array([n]))
        assert int((crc.at(np.array([n])) ^ moved)[0]) ^ 0xFFFFFFFF == zlib.crc32(data[:n].tobytes())


def brute_force(docs, target, percent, least, most, buckets, seed):
    raw, wanted = Counter(), Counter()
    for _, t in docs:
        raw += buckets_of(t, most, buckets)
    for t in target:
        wanted += buckets_of(t, most, buckets)
    s, t = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    rows = []
    for i, text in docs:
        own = buckets_of(text, most, buckets)
        weight = sum(gain(b) * n for b, n in own.items())
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, sum(own.values()), weight, score, len(words(text))])
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = order[: percent * len(order) // 100]
    return sorted([tuple(r[:4]) + (next((k for k, d in enumerate(drawn, 1) if d is r), None),) for r in rows], key=str)


@pytest.mark.parametrize("percent, least, most, buckets", [(10, 20, 1, 10_000), (50, 1, 2, 50), (100, 0, 1, 7), (0, 0, 1, 7)])
def test_brute_force(spark, documents, percent, least, most, buckets):
    rng = random.Random(buckets)
    texts = [" ".join(rng.choices(["one", "Two", "trois", "é", "42", "x-y"], k=rng.randrange(60))) for _ in range(150)]
    docs = [*enumerate(texts), *((1000 + k, t) for k, t in enumerate(ODD)), (None, "one two " * 20)]
    target = ["two two é", None, "", "four"]
    left = spark.createDataFrame([(n, t, n) for n, t in enumerate(target)], "rank int, text string, weight int")
    found = importance.resampled(documents(*docs), left, None, percent, least, max_words=most, buckets=buckets, seed=5)
    rows = sorted(((r.row["doc_id"], r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=str)
    assert rows == brute_force(docs, target, percent, least, most, buckets, 5)
    assert {r.row["n_words"] for r in found.collect()} == {"c"}


def test_repeated_rows_take_ranks_of_their_own(documents):
    docs = documents(*[(1, "a b c")] * 5, (2, "a"))
    found = importance.resampled(docs, docs, ["doc_id"], percent=100, min_words=2).collect()
    assert sorted(r["rank"] for r in found if r.row.doc_id == 1) == [1, 2, 3, 4, 5] and [r["rank"] for r in found if r.row.doc_id == 2] == [None]


def test_empty_tables(documents):
    some = documents("a b c")
    assert importance.resampled(documents(), some).count() == 0
    # Three times 1000 * ln(10003 / 20000), rounded down.
    assert [r.weight for r in importance.resampled(some, documents(), percent=100, min_words=0).collect()] == [3 * -693]


def test_buckets_are_bounded(documents):
    with pytest.raises(ValueError):
        importance.weighted(documents("a"), documents("a"), buckets=0)
