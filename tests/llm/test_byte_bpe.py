"""Byte-level BPE against the tiktoken library, and back."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm_cases import ODD, documents  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from sift.llm import byte_bpe
from sift.llm.words import chunks, texts_of

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = [
    "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", "\r\n", " ", "　", "a", "ab", "the", "é", "ß",
    "中文", "12", "½", "٣", "!", "...", "😀", "​", "\x1c", "\x85", "İ", "aaaaaaaa", "x" * 70, "中" * 40, "'S", "’s", "ab'", "́",
]


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return byte_bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.whole, special_tokens={})


def encoded(texts, ranks):
    out = []
    for _, _, part in chunks(texts_of(pa.array(texts, pa.string())), 64):
        ids, first = byte_bpe.encode(part, ranks)
        assert byte_bpe.decode(ids, ranks).tobytes() == part.data.tobytes()
        out += [ids[s:e].tolist() for s, e in zip(first[:-1], first[1:])]
    return out


@settings(max_examples=200, deadline=None)
@given(batch=st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), st.text(max_size=12)), max_size=6))
def test_ids_are_those_of_the_library(ranks, library, batch):
    assert encoded(batch, ranks) == [library.encode_ordinary(t) for t in batch]


def test_a_match_of_any_length(ranks, library):
    for text in ("ab" * 3000, "a" * 4097, "é" * 65, "x" * 64):
        assert encoded([text], ranks) == [library.encode_ordinary(text)]


def test_tables(documents, library):
    found = {r.row.doc_id: r for r in byte_bpe.encoded(documents(*ODD), PATH).collect()}
    for n, text in enumerate(ODD):
        assert found[n].ids == library.encode_ordinary(text or "") and found[n].decoded == (text or "").encode()
        assert found[n].row.row == "b"
    assert byte_bpe.encoded(documents(), PATH).count() == 0
