"""Token files: the library's ids, code lengths, and what is read back."""

from __future__ import annotations

import math
import random

import numpy as np
import public_tokenizers
import pytest
from llm_cases import ODD, documents  # noqa: F401
from tokenizers import Tokenizer

from sift.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "'s", "'t", "'re", "'ll", "'", " ", "  ", "\n", " ", "　", "A", "ab", "The", "é", "É", "ß", "中文", "12", "½", "٣", "!", "...", "😀",
    "\x1c", "\x85", "İ", "Σ", "ΑΣ ", "aaaaaaaa", "'S", "’s", "é", "ﬁ", "Ǆ", "ͅ", "한", "‍", "_", "<|endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return token_files.PieceEncoder(f.read())


def test_ids_are_those_of_the_library(encoder, library):
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(3000)] + ODD
    ids, first = encoder.encode(texts)
    for text, s, e in zip(texts, first[:-1], first[1:]):
        assert ids[s:e].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_added_tokens_have_their_ids_as_in_the_library_by_default(documents):
    library = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.PieceEncoder(f.read(), special=True)
    rng = random.Random(5)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]
    texts = ["".join(rng.choices(PARTS + 3 * marks, k=rng.randrange(12))) for _ in range(3000)] + ODD + ["<|endoftext|>"]
    ids, first = encoder.encode(texts)
    for text, s, e in zip(texts, first[:-1], first[1:]):
        assert ids[s:e].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    found = sorted(token_files.round_trip(documents("a <|endoftext|> b", "c"), PATH, end_id=2).collect(), key=lambda r: r.start)
    assert found[0].ids == [320, 49407, 321, 2] and found[1].start == 4


@pytest.mark.parametrize("limit", [20, 6, 4])
def test_code_lengths_are_a_full_code_within_the_limit(limit):
    counts = {n: 1 + 3**n % 100_003 for n in range(16)}
    lengths = token_files.code_lengths(counts, limit)
    assert max(lengths.values()) <= limit and sum(2.0**-n for n in lengths.values()) == 1
    # No worse than one bit over the entropy, where the limit allows any length.
    total = sum(counts.values())
    bits = sum(counts[s] * n for s, n in lengths.items()) / total
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    assert bits <= (entropy + 1 if limit == 20 else 4)


def test_few_symbols():
    assert token_files.code_lengths({}) == {} and token_files.code_lengths({7: 3}) == {7: 1}
    with pytest.raises(ValueError):
        token_files.code_lengths(dict.fromkeys(range(5), 1), 2)


def test_blocks_unpack_to_what_was_packed():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.02, 5000), 300)
    code = token_files.canonical(token_files.code_lengths(dict(zip(*map(list, np.unique(ids, return_counts=True))))))
    for n in (1, 255, 256, 257, 5000):
        payload, checkpoints = token_files.pack(ids[:n], code)
        assert token_files.unpack(payload, checkpoints, n, code).tolist() == ids[:n].tolist()


@pytest.mark.parametrize("block", [token_files.BLOCK_TOKENS, 7])
def test_files_give_the_ids_back_in_order(documents, library, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", block)
    table = [(3 * n % 31, t) for n, t in enumerate([*ODD, "some words here", "and more of them"])]
    table += [(None, "no id"), (0, "the same id"), (0, "the same id")]
    found = token_files.round_trip(documents(*table), PATH, end_id=2).collect()
    found.sort(key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids) and [r.start for r in found] == np.cumsum([0, *(len(r.ids) for r in found[:-1])]).tolist()
    expected = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in table]
    assert sorted((r.doc_id or -1, r.ids) for r in found) == sorted((d or -1, e) for (d, _), e in zip(table, expected))


def test_an_empty_table(documents):
    assert token_files.checked(token_files.round_trip(documents(), PATH, end_id=2)).count() == 0
