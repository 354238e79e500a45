"""Words, hashes and features against the definitions, on texts of every kind."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sift.llm import quality
from sift.llm.words import NOT_ALNUM, SPACES, chunks, split_words, texts_of, window_hash

TEXT = st.text(alphabet=st.sampled_from("aAbB é中😀 \t\n\r\x0b.,!#|<>0Z\x1c　"), max_size=60)
BATCH = st.lists(st.one_of(st.none(), TEXT), max_size=8)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=150, deadline=None)
@given(BATCH)
def test_words_are_those_of_the_patterns(batch):
    for separator, pattern in ((SPACES, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        expected = [[m.group() for m in re.finditer(pattern, lowered(t))] for t in batch]
        found = []
        for _, _, part in chunks(texts_of(pa.array(batch, pa.string())), 16):
            words = split_words(part, separator, fold=True)
            raw = lowered(part.data.tobytes().decode()).encode()
            spans = [raw[s:e].decode() for s, e in zip(words.start, words.end)]
            found += [spans[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
            # Equal words have equal hashes, and different ones different hashes.
            assert len(set(spans)) == len(set(words.hash.tolist())) == len(set(zip(spans, words.hash.tolist())))
        assert found == expected


def test_windows_of_equal_words_have_equal_hashes():
    texts = texts_of(pa.array(["p q r s", "x p q r s y", "p q s r"]))
    h = window_hash(split_words(texts, SPACES, fold=False), 4)
    assert h[0] == h[5] and h[0] != h[-1] and len(np.unique(h)) == len(h) - 1


@settings(max_examples=150, deadline=None)
@given(BATCH)
def test_rule_counts_are_those_of_the_definitions(batch):
    counts = quality.rule_counts(texts_of(pa.array(batch, pa.string())))
    for i, text in enumerate(batch):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        repeated = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(int(counts[name][i]) for name in quality.COUNTS[:5]) == expected


def test_no_texts_at_all():
    texts = texts_of(pa.array([], pa.string()))
    assert list(chunks(texts)) == []
    assert len(split_words(texts, SPACES, fold=True).hash) == 0


def regular_words(size):
    """The Thue-Morse word over two letters, and its complement."""
    bits = [bin(n).count("1") & 1 for n in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_regular_words_have_hashes_of_their_own():
    for size in (256, 257, 1024, 2048, 4096):
        words = split_words(texts_of(pa.array([" ".join(regular_words(size))])), SPACES, fold=True)
        assert len(set(words.hash.tolist())) == 2, size
