"""Suffix arrays and contamination against a plain search."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from llm_cases import ODD, documents  # noqa: F401

from sift.llm import decontam


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(text, items):
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(10, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if size and tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_a_suffix_array_sorts_all_suffixes():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (7, 2), (200, 2), (300, 50)):
        value = rng.integers(0, kinds, n).astype(np.uint64)
        value[-1] = 99
        order = decontam.suffix_array(value, n)
        suffixes = [value[k:].tolist() for k in order]
        assert suffixes == sorted(suffixes) and sorted(order.tolist()) == list(range(n))


@pytest.fixture
def case(spark, documents):
    rng = random.Random(9)
    base = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(rng.choices(base, k=k))) for n, k in enumerate((0, 1, 3, 9, 10, 11, 30, 60, 60))]
    items += [(20, None), (21, "..."), (22, items[-1][1]), (None, " ".join(rng.choices(base, k=20)))]
    texts = list(ODD)
    for _ in range(60):
        parts = [" ".join(rng.choices(base, k=rng.randrange(15)))]
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            cut = rng.randrange(len(own) + 1)
            parts += [" ".join(own[cut:]).upper(), ";".join(rng.choices(base, k=4))]
        texts.append(" ".join(parts))
    return texts, items, documents(*texts), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_hits_are_those_of_a_plain_search(case, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    texts, items, docs, test = case
    for r in decontam.contamination(docs, test).collect():
        n_words, n_hit, found = brute_force(texts[r.row.doc_id], items)
        named = [x for x in found if x != "None"]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n_words, n_hit, named)
        words = words_of(texts[r.row.doc_id])
        for m in r.matches:
            own = words_of(dict(items)[int(m.item_id)] if m.item_id else items[-1][1])
            assert words[m.word : m.word + m.n_words] == own[m.item_word : m.item_word + m.n_words]
    clean = {r.doc_id for r in decontam.decontaminated(docs, test).collect()}
    assert clean == {n for n, t in enumerate(texts) if not brute_force(t, items)[1]}


def test_no_items_and_no_documents(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.decontaminated(documents(*ODD), none).count() == len(ODD)
    assert decontam.contamination(documents(), none).count() == 0


def test_an_item_that_repeats_itself(spark, documents):
    """Windows that occur again and again: all words hit, matches verbatim, memory in proportion."""
    import tracemalloc

    item, text = "a " * 800 + "b " + "c d e f " * 40, "x " + "a " * 80_000 + "c d e f " * 300
    tracemalloc.start()
    found = documents(text)
    test = spark.createDataFrame([(1, item), (2, item), (3, "a " * 12)], "item_id bigint, text string")
    tests = decontam.test_set(["1", "2", "3"], decontam.pa.array([item, item, "a " * 12]))
    count, hits, (matches,) = decontam.matched(decontam.texts_of(decontam.pa.array([text])), tests)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    words, items = words_of(text), {"1": words_of(item), "2": words_of(item), "3": ["a"] * 12}
    covered = {i: set() for i in items}
    for m in matches:
        assert words[m["word"] : m["word"] + m["n_words"]] == items[m["item_id"]][m["item_word"] : m["item_word"] + m["n_words"]]
        covered[m["item_id"]].update(range(m["word"], m["word"] + m["n_words"]))
    assert len(matches) < 30_000 and hits[0].sum() == len(words) - 1 == len(covered["1"]) == len(covered["2"]) and len(covered["3"]) == 80_000
    (row,) = decontam.contamination(found, test).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (len(words), len(words) - 1, ["1", "2", "3"])


def test_a_run_that_passes_between_places_of_an_item():
    window = " ".join(f"w{n}" for n in range(10))
    item, text = f"{window} x {window} y", f"q {window} y {window} x {window}"
    tests = decontam.test_set(["1"], decontam.pa.array([item]))
    _, hits, (matches,) = decontam.matched(decontam.texts_of(decontam.pa.array([text])), tests)
    assert hits[0].sum() == 32
    assert [(m["item_word"], m["word"], m["n_words"]) for m in matches] == [(11, 1, 11), (0, 12, 21)]
