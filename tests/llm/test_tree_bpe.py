"""BPE by tree concatenation: the library's ids and decoded text, and each part of the method."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from llm_cases import ODD, documents  # noqa: F401
from test_words import regular_words
from tokenizers import Tokenizer

from sift.llm import tree_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "'s", "'t", "'re", "'", " ", "  ", "\n", "　", "A", "ab", "The", "é", "É", "ß", "中文", "12", "½", "!", "...", "😀", "\x1c", "\x85",
    "İ", "Σ", "ΑΣ ", "aaaaaaaa", "ﬁ", "Ǆ", "한", "_", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "tion", "heed",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    with open(PATH, encoding="utf-8") as f:
        return tree_bpe.parse(f.read())


def check(texts, library, merges):
    ids, first = tree_bpe.encode(texts, merges)
    back, at = tree_bpe.decode(ids, first, merges)
    assert len(first) == len(texts) + 1 and first[-1] == len(ids)
    for n, text in enumerate(texts):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert ids[first[n] : first[n + 1]].tolist() == expected, text
        assert back[at[n] : at[n + 1]].tobytes().decode() == library.decode(expected, skip_special_tokens=False), text


def test_ids_and_texts_are_those_of_the_library(library, merges):
    rng = random.Random(13)
    check(["".join(rng.choices(PARTS, k=rng.randrange(14))) for _ in range(3000)] + ODD, library, merges)
    check([], library, merges)
    check([None, ""], library, merges)


def test_long_unsplit_texts(library, merges):
    """Random letters, runs of one letter, words without spaces, and regular words."""
    rng = random.Random(14)
    words = "the internationalisation of a thousand unbreakable heedless tionally".split()
    texts = ["".join(rng.choices(letters, k=size)) for letters in ("ab", "aeinst", "abcdefghijklmnopqrstuvwxyz", "é中a", ".,!-") for size in (63, 64, 65, 129, 1000, 20_000)]
    texts += ["a" * size for size in (64, 65, 127, 4096, 10_001)] + ["".join(rng.choices(words, k=3000)), "ha" * 5000, "=" * 7000]
    texts += [w for size in (256, 1024, 4096) for w in regular_words(size)] + [" ".join(regular_words(1024))]
    check(texts, library, merges)


def test_a_text_of_two_million_letters(library, merges):
    rng = random.Random(15)
    check(["x " + "".join(rng.choices("etaoinshrdlu", k=2_000_000)) + " y", "z"], library, merges)


@pytest.mark.parametrize("leaf, window", [(1, 1), (2, 1), (3, 2), (7, 1), (64, 1), (10_000, 2)])
def test_any_leaf_and_window_give_the_same(merges, leaf, window):
    """Joins decide exactly whatever the parts are, also from single symbols up."""
    rng = np.random.default_rng(16)
    size = rng.integers(1, 60, 300)
    first = np.concatenate([[0], np.cumsum(size)])
    symbols = merges.byte[rng.choice(np.frombuffer(b"aeinstrhe", dtype=np.uint8), first[-1])]
    expected, at = tree_bpe.merged(symbols, first, merges)
    tokens, begins = tree_bpe.encode_sequences(symbols, first, merges, leaf, window)
    assert tokens.tolist() == expected.tolist() and begins.tolist() == np.searchsorted(at, first).tolist()


def test_halves_cover_every_sequence():
    bounds, levels = tree_bpe.halves(np.array([0, 3, 3, 20, 21]), leaf=4)
    assert max(np.diff(bounds)) <= 4 and {0, 3, 20, 21} <= set(bounds.tolist())
    assert all((a < b).all() and (b < c).all() for a, b, c in levels)
    assert levels[-1].tolist() == [[3], [12], [20]]


def test_rows_keep_their_columns(documents, library):
    texts = [*ODD, "twice", "twice"]
    found = tree_bpe.encoded(documents(*texts), PATH).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.row["doc_id"]] or ""
        assert (r.row["row"], r.row["n_words"], r.row["a.b c"]) == ("b", "c", "d")
        expected = library.encode(text, add_special_tokens=False).ids
        assert r.ids == expected and r.decoded == library.decode(expected, skip_special_tokens=False)
    assert tree_bpe.encoded(documents(), PATH).count() == 0


def test_other_files_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises((ValueError, KeyError, TypeError)):
        tree_bpe.parse(f.read())
