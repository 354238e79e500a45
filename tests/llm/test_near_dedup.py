"""Near-duplicates against all pairs, and the ways a table may be odd."""

from __future__ import annotations

import random
import re

import pytest
from llm_cases import ODD, documents, rows  # noqa: F401

from sift.llm import near_dedup
from sift.llm.near_dedup import deduplicated, near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_force(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    linked = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    for _ in sets:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(((i, len(s), label[i], label[i] == i) for i, s in sets.items()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("percent", [80, 85])
def test_classes_are_those_of_all_pairs(documents, rows, percent):
    rng = random.Random(percent)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        texts += [" ".join(words)] * rng.randrange(1, 4)
        texts += [edited(rng, words, n) for n in (1, 1, 2, 3, 5, 9)]
        # A chain: neighbours are alike, its ends are not.
        for _ in range(4):
            words = edited(rng, words, max(1, len(words) // 90)).split()
            texts.append(" ".join(words).upper())
    texts += ODD
    rng.shuffle(texts)
    table = list(enumerate(texts))
    found = near_duplicates(documents(*table), percent)
    assert rows(found) == brute_force(table, percent)


def test_a_large_group_of_copies_and_of_near_copies(documents, rows):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(200)]
    texts = [" ".join(words)] * 150 + [edited(rng, words, 1) for _ in range(150)]
    found = near_duplicates(documents(*texts)).collect()
    assert {r.component_id for r in found} == {0} and [r.doc_id for r in found if r.kept] == [0]


@pytest.mark.parametrize("block_bytes", [near_dedup.BLOCK_BYTES, 100_000])
def test_pairs_in_buckets_crowded_by_a_template_just_below_the_threshold(documents, rows, monkeypatch, block_bytes):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block_bytes)
    template = [f"w{n}" for n in range(200)]
    tails = [[f"t{d}x{n}" for n in range(20)] for d in range(400)]
    for d in range(0, 80, 2):
        tails[d + 1][:4] = tails[d][:4]
    table = [(d, " ".join(template + tail)) for d, tail in enumerate(tails)]
    expected = brute_force(table, 85)
    assert sum(not row[3] for row in expected) == 40
    assert rows(near_duplicates(documents(*table), 85)) == expected


def test_repeated_and_missing_ids(documents, rows):
    text = "one two three four five six seven"
    found = near_duplicates(documents((5, text), (5, text), (None, text), (7, text), (8, None)))
    assert rows(found) == sorted([(5, 3, 5, True), (5, 3, 5, True), (None, 3, None, True), (7, 3, 5, False), (8, 0, 8, True)], key=str)
    left = deduplicated(documents((5, text), (5, text), (None, text), (7, text), (8, None)))
    assert rows(left, "doc_id") == sorted([(5,), (None,), (8,)], key=str)
    assert left.columns == documents().columns


def test_an_empty_table(documents):
    assert near_duplicates(documents()).count() == 0 and deduplicated(documents()).count() == 0
