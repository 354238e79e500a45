"""Secret scans: keywords first, a pattern only where a keyword was hit, then checksums.

One pass of an Aho-Corasick automaton over a text finds the words that introduce a
credential, the fixed prefixes of tokens, and what no run of 16 hexadecimal digits
can lack: a decimal digit, or five letters ``a`` to ``f`` in a row. Patterns are
anchored at these places. Tokens whose format ends in a checksum count only if the
checksum is right.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm import frames
from sift.llm.words import chunks, texts_of

# Keywords, patterns and least lengths of the scan.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Prefixes of tokens that carry 30 random characters and the CRC-32 of these in base 62.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "checked")
MASK = "[secret]"

_HEX_DIGITS = frozenset("0123456789abcdef")
_automaton: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    """Built once in every process; all keywords are lower-case."""
    global _automaton
    if _automaton is None:
        made = ahocorasick.Automaton()
        for word in ASSIGN_WORDS:
            made.add_word(word, ("assign", len(word)))
        made.add_word("akia", ("access", 4))
        for prefix in CHECKED_PREFIXES:
            made.add_word(prefix, ("checked", 4))
        for digit in "0123456789":
            made.add_word(digit, ("hex", 1))
        for letters in product("abcdef", repeat=5):
            made.add_word("".join(letters), ("hex", 5))
        made.make_automaton()
        _automaton = made
    return _automaton


def checksum(body: str) -> str:
    """CRC-32 in six digits of base 62."""
    rest, out = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        out = BASE62[digit] + out
    return out


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then in the order of ``KINDS``."""
    done = dict.fromkeys(KINDS, 0)
    found = []
    # Only A-Z are lowered, so every place in the lowered text is the same in the text.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for last, (kind, length) in automaton().iter(lowered):
        start = last - length + 1
        if kind == "hex":
            if last < done["hex"] or text[last] not in _HEX_DIGITS or text[start] not in _HEX_DIGITS:
                continue
            start = max(start, done["hex"])
            while start > done["hex"] and text[start - 1] in _HEX_DIGITS:
                start -= 1
            end = HEX.match(text, start).end()
            done["hex"] = end
            if end - start >= HEX_LEAST:
                found.append(("hex", start, end))
        elif start < done[kind]:
            continue
        elif kind == "assign":
            if m := ASSIGN.match(text, start):
                done[kind] = m.end()
                if len(m[2]) >= ASSIGN_LEAST:
                    found.append((kind, start, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                done[kind] = m.end()
                if m.end() - start >= ACCESS_LEAST:
                    found.append((kind, start, m.end()))
        elif (m := CHECKED.match(text, start)) and checksum(m[1]) == m[2]:
            done[kind] = m.end()
            found.append((kind, start, m.end()))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``MASK``."""
    out, at = [], 0
    for _, start, end in found:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets_in(docs: DataFrame, keep: list[str] | None = None, mask: bool = False) -> DataFrame:
    """For every row of ``docs``: ``row``, ``spans`` and, if ``mask``, ``masked``.

    ``row`` holds the columns ``keep`` (all, if not given) as a struct, so their names
    cannot clash; ``spans`` is an array of ``kind, start, end`` in code points. ``masked``
    is the text without its secrets, null where the text is null. A null or empty text
    has no spans; equal texts get equal spans; an empty table gives no rows.
    """
    rows = frames.packed(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _ in chunks(texts_of(batch.column(1))):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                found = [find_secrets(t) if t else [] for t in texts]
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found]
                out = [batch.column(0).slice(lo, hi - lo), pa.array(spans, _SPANS)]
                if mask:
                    out.append(pa.array([masked(t, f) if f else t for t, f in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["row", "spans", "masked"][: len(out)])

    fields = "spans array<struct<kind:string,start:bigint,end:bigint>>" + (", masked string" if mask else "")
    return rows.mapInArrow(run, frames.with_row(rows, fields))


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars``, if there, counted anew."""
    found = secrets_in(docs, mask=True)
    columns = []
    for name, kind in docs.dtypes:
        new = {"text": F.col("masked"), "n_chars": F.when(F.size("spans") > 0, F.length("masked")).otherwise(F.col("row.n_chars")) if name == "n_chars" else None}.get(name)
        columns.append(F.col("row").getField(name).alias(name) if new is None else new.cast(kind).alias(name))
    return found.select(*columns)
