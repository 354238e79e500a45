"""Byte-level BPE: a segment tree over byte positions holds the leftmost least pair rank.

A text is split into the matches of the tokenizer's pattern, here by arithmetic on
the classes of its code points. Every distinct match of a chunk is encoded once: the
leaf of a byte position holds the rank of the pair that begins there, an inner node
the least of its children, so the root names the next merge. A merge changes the
leaves of the two live neighbours and of the byte that is swallowed, and the paths
above these. Matches of about equal length are one forest, which numpy updates one
merge at a time for all of its trees; a long match has a tree of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sift.llm import frames
from sift.llm.words import Texts, chunks, continuation_free, mix, span_hash, texts_of

#: Matches up to so many bytes share forests; longer ones get a tree each.
FOREST_BYTES = 64
#: Trees of one forest at most, which bounds its memory.
FOREST_TREES = 1 << 15
NEVER = np.int64(1 << 40)

# Unicode White_Space, which is what \s means to the pattern.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# The endings that the pattern splits off after an apostrophe.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")

SPACE, LETTER, NUMBER, OTHER = range(4)
_classes: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    """The class of every code point, from the Unicode properties that ``regex`` knows."""
    global _classes
    if _classes is None:
        import regex

        table = np.full(0x110000, OTHER, dtype=np.uint8)
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, points):
                first, last = ord(m[0][0]), ord(m[0][-1])
                table[first : last + 1] = kind
        table[0xD800:0xE000] = OTHER
        table[list(WHITE_SPACE)] = SPACE
        _classes = table
    return _classes


def pattern_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a match; ``first`` marks those that begin a text.

    Space characters before a word: the last one, if it is a plain space, belongs to
    the word, else it stands alone; those before it are one match. Space characters
    that end a text are one match.
    """
    n = len(points)
    kind = code_point_classes()[points]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[:1] = True
    space = kind == SPACE
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = (points[:-1] == 0x20) & ~first[1:]
    begins = run & (space | ~after_blank)
    last_space = np.zeros(n, dtype=bool)
    last_space[:-1] = space[:-1] & run[1:] & ~first[1:]
    begins |= last_space
    # A short ending only counts where a match can begin at its apostrophe.
    mark = np.flatnonzero(begins & (points == 0x27))
    for endings in (SHORT_ENDINGS, LONG_ENDINGS):
        size = len(endings[0])
        at = mark[mark + size < n]
        fits = np.zeros(len(at), dtype=bool)
        for ending in endings:
            fits |= np.all([points[at + 1 + k] == ord(c) for k, c in enumerate(ending)], axis=0)
        for k in range(size):
            fits &= ~first[at + 1 + k]
        at = at[fits]
        begins[at + 1] = False
        beyond = at + 1 + size
        begins[beyond[beyond < n]] = True
    return begins


@dataclass
class Ranks:
    """A rank file as arrays: single bytes, pairs in an open-addressed table, token bytes."""

    whole: dict[bytes, int]
    byte: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    data: np.ndarray
    offset: np.ndarray
    token_key: np.ndarray
    token: np.ndarray

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's bytes, ``NEVER`` where they are no token."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        mask = np.uint64(len(self.keys) - 1)
        slot = mix(key) & mask
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], NEVER)
        todo = np.flatnonzero((there != key) & (there != _FREE))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & mask
            there = self.keys[slot[todo]]
            same = there == key[todo]
            out[todo[same]] = self.values[slot[todo[same]]]
            todo = todo[~same & (there != _FREE)]
        return out

    def pair_of(self, left: int, right: int) -> int:
        return int(self.pair(np.array([left]), np.array([right]))[0])


_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
_loaded: dict[bytes, Ranks] = {}


def parse_ranks(raw: bytes) -> Ranks:
    """Ranks from the lines ``base64 rank`` of a rank file; parsed once in a process."""
    if raw in _loaded:
        return _loaded[raw]
    whole = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
    byte = np.array([whole[bytes([b])] for b in range(256)], dtype=np.int64)
    left, right, value = [], [], []
    for token, rank in whole.items():
        for cut in range(1, len(token)):
            a, b = whole.get(token[:cut]), whole.get(token[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), value.append(rank)
    key = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
    size = 1 << max(4, (2 * len(key)).bit_length())
    keys, values = np.full(size, _FREE), np.zeros(size, dtype=np.int64)
    slot = mix(key) & np.uint64(size - 1)
    todo = np.arange(len(key))
    rank = np.array(value, dtype=np.int64)
    while len(todo):
        free = keys[slot[todo]] == _FREE
        # Of several that want one slot the last write wins; the others go on.
        keys[slot[todo[free]]], values[slot[todo[free]]] = key[todo[free]], rank[todo[free]]
        todo = todo[keys[slot[todo]] != key[todo]]
        slot[todo] = (slot[todo] + np.uint64(1)) & np.uint64(size - 1)
    by_rank = sorted(whole.items(), key=lambda item: item[1])
    offset = np.zeros(by_rank[-1][1] + 2, dtype=np.int64)
    for token, number in by_rank:
        offset[number + 1] = len(token)
    data = np.frombuffer(b"".join(token for token, _ in by_rank), dtype=np.uint8)
    offset = np.cumsum(offset)
    token = np.array([number for _, number in by_rank], dtype=np.int64)
    token_key = span_hash(data, offset[token], offset[token + 1])
    sort = np.argsort(token_key)
    _loaded[raw] = Ranks(whole, byte, keys, values, data, offset, token_key[sort], token[sort])
    return _loaded[raw]


def ragged(offset: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a flat array of the items ``which``, end to end, and their lengths."""
    size = offset[which + 1] - offset[which]
    shift = offset[which] - (np.cumsum(size) - size)
    return np.repeat(shift, size) + np.arange(size.sum()), size


def merge_forest(tokens: np.ndarray, size: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Merge rows of single-byte tokens (width a power of two); tokens left, and how many a row."""
    n, width = tokens.shape
    tokens = tokens.copy()
    column = np.arange(width)
    live = column < size[:, None]
    after = np.where(column + 1 < size[:, None], column + 1, -1)
    before = np.where(live, column - 1, -1)
    tree = np.full((n, 2 * width), NEVER * width)
    row, at = np.nonzero(after >= 0)
    rank = ranks.pair(tokens[row, at], tokens[row, at + 1])
    tree[row, width + at] = rank * width + at
    level = width
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half
    limit = NEVER * width

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[rows, node] = value
        while width > 1 and len(node) and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] < limit)
    while len(rows):
        least = tree[rows, 1]
        at, merged = least % width, least // width
        gone = after[rows, at]
        next_ = after[rows, gone]
        tokens[rows, at] = merged
        live[rows, gone] = False
        after[rows, at] = next_
        more = next_ >= 0
        before[rows[more], next_[more]] = at[more]
        value = np.full(len(rows), limit)
        put(rows, gone, value)
        rank = ranks.pair(merged[more], tokens[rows[more], next_[more]])
        value[more] = np.minimum(rank * width + at[more], limit)
        put(rows, at, value)
        prior = before[rows, at]
        has = prior >= 0
        r, p = rows[has], prior[has]
        put(r, p, np.minimum(ranks.pair(tokens[r, p], merged[has]) * width + p, limit))
        rows = rows[tree[rows, 1] < limit]
    return tokens[live], live.sum(axis=1)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """The tokens of one long match, by a segment tree of its own."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    tokens = ranks.byte[np.frombuffer(piece, dtype=np.uint8)]
    limit = int(NEVER)
    rank = np.full(width, NEVER)
    rank[: n - 1] = ranks.pair(tokens[:-1], tokens[1:])
    levels = [rank]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [limit, *(int(v) for level in reversed(levels) for v in level)]
    tokens = tokens.tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        node = leaf + width
        tree[node] = value
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left <= right else right

    known: dict[tuple[int, int], int] = {}

    def pair(a: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = ranks.pair_of(a, b)
        return known[a, b]

    while tree[1] < limit:
        least, node = tree[1], 1
        while node < width:
            node = 2 * node if tree[2 * node] == least else 2 * node + 1
        at = node - width
        gone = after[at]
        next_ = after[at] = after[gone]
        tokens[at] = least
        tokens[gone] = -1
        put(gone, limit)
        if next_ >= 0:
            before[next_] = at
        put(at, pair(least, tokens[next_]) if next_ >= 0 else limit)
        if before[at] >= 0:
            put(before[at], pair(tokens[before[at]], least))
    return [t for t in tokens if t >= 0]


def encode_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the matches ``data[start:end]`` end to end, and how many each has.

    ``key`` has the matches' hashes: one that is a token itself needs no merges.
    """
    size = end - start
    slot = np.minimum(np.searchsorted(ranks.token_key, key), len(ranks.token_key) - 1)
    is_token = ranks.token_key[slot] == key
    which, flats, counts = [np.flatnonzero(is_token)], [ranks.token[slot[is_token]]], [np.ones(is_token.sum(), dtype=np.int64)]
    rest = np.flatnonzero(~is_token)
    width = 4
    while width <= FOREST_BYTES:
        own = rest[(size[rest] <= width) & (size[rest] > (width // 2 if width > 4 else 0))]
        for lo in range(0, len(own), FOREST_TREES):
            part = own[lo : lo + FOREST_TREES]
            place = np.minimum(start[part][:, None] + np.arange(width), len(data) - 1)
            flat, count = merge_forest(ranks.byte[data[place]], size[part], ranks)
            which.append(part), flats.append(flat), counts.append(count)
        width *= 2
    for i in rest[size[rest] > FOREST_BYTES]:
        tokens = merge_one(data[start[i] : end[i]].tobytes(), ranks)
        which.append([i]), flats.append(np.array(tokens)), counts.append([len(tokens)])
    order = np.argsort(np.concatenate(which))
    count = np.concatenate(counts)
    place, size = ragged(np.concatenate([[0], np.cumsum(count)]), order)
    return np.concatenate(flats)[place].astype(np.int32), size


def encode(texts: Texts, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts end to end, and where each text's ids begin (one more: the end)."""
    data = texts.data
    bounds = np.append(texts.start, texts.end[-1:] if len(texts) else [0])
    if not len(data):
        return np.zeros(0, dtype=np.int32), np.zeros(len(bounds), dtype=np.int64)
    byte_at = np.flatnonzero(continuation_free(data))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    first_byte = np.zeros(len(data) + 1, dtype=bool)
    first_byte[texts.start] = True
    begins = byte_at[pattern_starts(points, first_byte[byte_at])]
    ends = np.append(begins[1:], len(data))
    key = span_hash(data, begins, ends)
    key, sample, which = np.unique(key, return_index=True, return_inverse=True)
    flat, count = encode_pieces(data, begins[sample], ends[sample], key, ranks)
    offset = np.concatenate([[0], np.cumsum(count)])
    place, size = ragged(offset, which)
    upto = np.concatenate([[0], np.cumsum(size)])
    return flat[place], upto[np.searchsorted(begins, bounds)]


def decode(ids: np.ndarray, ranks: Ranks) -> np.ndarray:
    """The bytes of the tokens, end to end."""
    place, _ = ragged(ranks.offset, ids.astype(np.int64))
    return ranks.data[place]


def encoded(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """For every row of ``docs``: ``row``, ``ids`` (array of int) and ``decoded`` (binary).

    ``row`` holds the columns ``keep`` (all, if not given) as a struct, so their names
    cannot clash. ``path`` names a rank file on the driver; its bytes are sent to the
    tasks. A null or empty text has no ids and decodes to no bytes; equal texts get
    equal ids; an empty table gives no rows.
    """
    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = frames.packed(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = parse_ranks(raw.value)
        for batch in batches:
            for lo, hi, part in chunks(texts_of(batch.column(1))):
                ids, first = encode(part, ranks)
                size = np.concatenate([[0], np.cumsum(ranks.offset[ids + 1] - ranks.offset[ids])])
                back = pa.py_buffer(decode(ids, ranks).tobytes())
                bytes_at = pa.py_buffer(size[first].astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)),
                        pa.Array.from_buffers(pa.binary(), hi - lo, [None, bytes_at, back]),
                    ],
                    names=["row", "ids", "decoded"],
                )

    return rows.mapInArrow(run, frames.with_row(rows, "ids array<int>, decoded binary"))
