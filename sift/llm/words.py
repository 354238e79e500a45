"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Both word definitions in use separate words by ASCII bytes only, so a word is a
run of bytes and no Python string is made for it. A word is known by a 64-bit
hash of its bytes; windows of words by a hash of those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 19
#: Longer spans are hashed from their bytes: modulo a power of two, running sums give
#: different long words of a regular pattern one value (Thue-Morse words of 1,024 letters).
LONG_SPAN = 256

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (MurmurHash3's finalizer)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x = x * _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Separators of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
SPACES = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
NOT_ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class _Powers:
    """Powers of the base and of its inverse, as many as were ever needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Texts:
    """Texts end to end in ``data``; text i is ``data[start[i]:end[i]]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


@dataclass
class Words:
    """Words in order; those of text i are ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    data = data[: offsets[-1]]
    end = offsets[1:]
    if column.null_count:
        end = np.where(column.is_valid().to_numpy(zero_copy_only=False), end, offsets[:-1])
    return Texts(data, offsets[:-1], end)


def chunks(texts: Texts, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of about ``size`` bytes, moved to a start of 0."""
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(texts.end, texts.start[lo] + size, side="right")))
        base = texts.start[lo]
        part = texts.data[base : texts.end[lo:hi].max()] if hi > lo else texts.data[:0]
        yield lo, hi, Texts(part, texts.start[lo:hi] - base, texts.end[lo:hi] - base)
        lo = hi


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each ``data[start:end]``, from running sums; the place does not matter."""
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    value = mix((sums[end] - sums[start]) * down[start])
    for i in np.flatnonzero(end - start > LONG_SPAN).tolist():
        own = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8)
        value[i] = int.from_bytes(own.digest(), "little")
    return value


def split_words(texts: Texts, separator: np.ndarray, fold: bool) -> Words:
    """Words between separator bytes, with ``A-Z`` lower-cased first if ``fold``."""
    data = LOWER[texts.data] if fold else texts.data
    n = len(data)
    inside = ~separator[data]
    # A word never crosses from one text into the next.
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = np.zeros(n + 1, dtype=bool)
    ends[1:n] = inside[:-1] & ~inside[1:]
    if n:
        ends[n] = inside[-1]
    full = texts.end > texts.start
    edges = texts.start[full]
    begins[edges] = inside[edges]
    cut = edges[edges > 0]
    ends[cut] |= inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    value = span_hash(data, start, end)
    first = np.searchsorted(start, np.append(texts.start, texts.end[-1:] if len(texts) else [0]))
    return Words(start, end, first, value)


def window_hash(words: Words, size: int) -> np.ndarray:
    """For each word the hash of ``size`` words from it on, also across texts."""
    n = max(0, len(words.hash) - size + 1)
    value = np.full(n, mix(np.array([size], dtype=np.uint64))[0])
    for k in range(size):
        value = value * _U(_BASE) + words.hash[k : k + n]
    return mix(value)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash ``window_hash`` gives for exactly these words."""
    value = mix(np.array([len(hashes)], dtype=np.uint64))
    for h in hashes:
        value = value * _U(_BASE) + h
    return mix(value)[0]


def continuation_free(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80
