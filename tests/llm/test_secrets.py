"""Secret scans against plain patterns."""

from __future__ import annotations

import random

from llm_cases import ODD, documents  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from sift.llm import secrets
from sift.llm.secrets import ACCESS, ASSIGN, HEX, KINDS, checksum, find_secrets, masked

PARTS = [
    "password", "PassWord", "passwd", "token", "secret", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "abcdef", "0123",
    "deadbeef", "AKIA", "akia", "ABCDEFGHIJ", "Z9", "é", "İ", "ſecret", "x" * 13, "feedface", "\n", "😀", "-", "fade", "npm_", "ghp_",
]


def base(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert [f for f in find_secrets(text) if f[0] in secrets.BASE_KINDS] == base(text)


def test_checksums_decide():
    rng = random.Random(1)
    body = "".join(rng.choices(secrets.BASE62, k=30))
    for prefix in secrets.CHECKED_PREFIXES:
        text = f"é {prefix}{body}{checksum(body)} end"
        assert find_secrets(text) == [("checked", 2, 42)]
        wrong = "0" if body[0] != "0" else "1"
        assert find_secrets(f"{prefix}{wrong}{body[1:]}{checksum(body)}") == []


def test_masking_and_odd_texts(documents):
    text = 'x token = "abcdefabcdef0123456789" y'
    assert masked(text, find_secrets(text)) == 'x [secret]" y'
    docs = documents(text, *ODD)
    found = {r.row.doc_id: r for r in secrets.secrets_in(docs).collect()}
    assert [s.kind for s in found[0].spans] == ["assign", "hex"] and found[1].spans == []
    left = {r.doc_id: r.text for r in secrets.without_secrets(docs).collect()}
    assert left == {0: 'x [secret]" y', **{n + 1: t for n, t in enumerate(ODD)}}
    assert secrets.without_secrets(docs).columns == docs.columns
    assert secrets.without_secrets(documents()).count() == 0
