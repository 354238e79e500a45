"""BPE with word ends by tree concatenation.

A text is normalised and split into pieces; a piece is a sequence of byte symbols, the
last of them with the word's end. Every distinct piece of a chunk is encoded once, all of
them side by side: a round merges, in each, the leftmost pair of least rank.

A long piece is halved until its parts are short, and its parts are encoded with the
other pieces, side by side. Then neighbours are joined, level by level up the tree and
all joins of a level at once: a window of some tokens on both sides of the join is
encoded again from its symbols, and grows until its first and its last token are those
that were there before. That decides the join exactly, since a sequence of tokens is the
encoding of its text if and only if each two neighbours are the encoding of theirs: the
first merge that crossed a border would cross it in these two alone as well.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sift.llm import frames
from sift.llm.byte_bpe import ragged
from sift.llm.token_files import _pieces as piece_bounds
from sift.llm.words import chunks, span_hash, texts_of

#: Symbols of a part that is encoded as one; longer pieces are halved.
LEAF = 64
#: Tokens on each side of a join that are encoded again at first.
WINDOW = 2
#: Symbols merged side by side at once, which bounds the memory of a round.
LANES = 1 << 21

NEVER = np.int64(1 << 62)


@dataclass
class Merges:
    """A tokenizer file as arrays: symbols of bytes, merges by pair, strings of ids."""

    byte: np.ndarray
    last: np.ndarray
    pair: np.ndarray
    rank: np.ndarray
    product: np.ndarray
    width: int
    text: np.ndarray
    offset: np.ndarray
    added: dict[str, int]
    mark: re.Pattern | None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, ``NEVER`` where it does not merge."""
        key = left * self.width + right
        slot = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[slot] == key, self.rank[slot], NEVER)


def byte_alphabet() -> list[str]:
    """The character of each byte: itself where it can be printed, else one beyond Latin-1."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def parse(raw: str) -> Merges:
    """The merges of a tokenizer file of this kind; anything else in it is refused."""
    whole = json.loads(raw)
    model, suffix = whole["model"], whole["model"]["end_of_word_suffix"]
    steps = [n["type"] for n in whole["normalizer"]["normalizers"]]
    split = [n["type"] for n in whole["pre_tokenizer"]["pretokenizers"]]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if steps != ["NFC", "Replace", "Lowercase"] or split != ["Split", "ByteLevel"] or not suffix or not plain or whole.get("decoder"):
        raise ValueError("not a BPE of lower-cased words with word ends")
    added = whole.get("added_tokens") or []
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that are not matched literally are not supported")
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    named = vocab | {t["content"]: t["id"] for t in added}
    width = max(named.values()) + 1
    left, right, product = (np.array([vocab[f(a, b)] for a, b in merges], dtype=np.int64) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
    key = left * width + right
    order = np.argsort(key, kind="stable")
    # Of a pair that is listed twice the later rank holds.
    own = np.append(key[order][1:] != key[order][:-1], True)
    order = order[own]
    strings = [b""] * width
    for text, number in named.items():
        strings[number] = text.encode()
    longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
    alphabet = byte_alphabet()
    return Merges(
        byte=np.array([vocab[c] for c in alphabet], dtype=np.int64),
        last=np.array([vocab[c + suffix] for c in alphabet], dtype=np.int64),
        pair=key[order], rank=order.astype(np.int64), product=product, width=width,
        text=np.frombuffer(b"".join(strings), dtype=np.uint8),
        offset=np.concatenate([[0], np.cumsum([len(s) for s in strings])]),
        added={t["content"]: t["id"] for t in added},
        mark=re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None,
    )


def merged(symbols: np.ndarray, first: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the sequences ``symbols[first[i]:first[i + 1]]``, and the place each begins at.

    All sequences advance together, one merge a round: that of the least rank, leftmost.
    """
    n = len(symbols)
    token, place = symbols.astype(np.int64), np.arange(n)
    done_token, done_place = [], []
    seq = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rank = np.full(n, NEVER)
    if n > 1:
        rank[:-1] = np.where(seq[1:] == seq[:-1], merges.rank_of(token[:-1], token[1:]), NEVER)
    while len(token):
        begin = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        size = np.diff(np.append(begin, len(seq)))
        least = np.minimum.reduceat(rank, begin)
        ended = np.repeat(least == NEVER, size)
        if ended.any():
            done_token.append(token[ended]), done_place.append(place[ended])
            rest = ~ended
            token, place, seq, rank = token[rest], place[rest], seq[rest], rank[rest]
            begin, size, least = begin[least < NEVER], size[least < NEVER], least[least < NEVER]
            begin = np.cumsum(size) - size
            if not len(token):
                break
        hit = np.flatnonzero(rank == np.repeat(least, size))
        at = hit[np.append(True, seq[hit][1:] != seq[hit][:-1])]
        token[at] = merges.product[rank[at]]
        keep = np.ones(len(token), dtype=bool)
        keep[at + 1] = False
        token, place, seq, rank = token[keep], place[keep], seq[keep], rank[keep]
        at = at - np.arange(len(at))
        # Only the pairs on both sides of a merge are new.
        for left in (at, at[at > 0] - 1):
            right = np.minimum(left + 1, len(token) - 1)
            inside = (right > left) & (seq[right] == seq[left])
            rank[left] = np.where(inside, merges.rank_of(token[left], token[right]), NEVER)
    if not done_token:
        return token, place
    token, place = np.concatenate(done_token), np.concatenate(done_place)
    order = np.argsort(place)
    return token[order], place[order]


def _in_lanes(symbols: np.ndarray, first: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """``merged``, some ``LANES`` symbols at a time."""
    tokens, places, lo = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + LANES, side="right")) - 1)
        token, place = merged(symbols[first[lo] : first[hi]], first[lo : hi + 1] - first[lo], merges)
        tokens.append(token), places.append(place + first[lo])
        lo = hi
    return np.concatenate(tokens), np.concatenate(places)


def halves(first: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds of all parts, and per level, lowest first, the joins as (left end, border, right end).

    Parts longer than ``leaf`` are halved.
    """
    bounds, levels = first, []
    while True:
        size = np.diff(bounds)
        long = np.flatnonzero(size > leaf)
        if not len(long):
            return bounds, levels[::-1]
        border = bounds[long] + (size[long] + 1) // 2
        levels.append(np.stack([bounds[long], border, bounds[long + 1]]))
        bounds = np.sort(np.concatenate([bounds, border]))


def joined(symbols: np.ndarray, token: np.ndarray, joins: np.ndarray, merges: Merges, window: int = WINDOW) -> np.ndarray:
    """``token`` (per symbol the token that begins there, else -1) after the joins of one level."""
    begins = np.flatnonzero(token >= 0)
    left_end, border, right_end = joins
    slot = np.searchsorted(begins, border)
    lowest, highest = np.searchsorted(begins, left_end), np.searchsorted(begins, right_end)
    begins = np.append(begins, len(symbols))
    open_, size = np.arange(len(border)), window
    out = token.copy()
    while len(open_):
        lo = np.maximum(slot[open_] - size, lowest[open_])
        hi = np.minimum(slot[open_] + size, highest[open_])
        start, end = begins[lo], begins[hi]
        first = np.concatenate([[0], np.cumsum(end - start)])
        source = np.arange(first[-1]) + np.repeat(start - first[:-1], end - start)
        new, place = _in_lanes(symbols[source], first, merges)
        begin_of = np.searchsorted(place, first)
        head, tail = begin_of[:-1], begin_of[1:] - 1
        agrees = (lo == lowest[open_]) | (new[head] == token[start])
        agrees &= (hi == highest[open_]) | (new[tail] == token[begins[hi - 1]])
        # The symbols of the windows that agree get their new tokens.
        fresh = np.full(first[-1], -1, dtype=np.int64)
        fresh[place] = new
        taken = np.repeat(agrees, end - start)
        out[source[taken]] = fresh[taken]
        open_, size = open_[~agrees], 2 * size
    return out


def encode_sequences(symbols: np.ndarray, first: np.ndarray, merges: Merges, leaf: int = LEAF, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all sequences end to end, and where each sequence's begin (one more: the end)."""
    parts, levels = halves(first, leaf)
    tokens, place = _in_lanes(symbols, parts, merges)
    if levels:
        token = np.full(len(symbols), -1, dtype=np.int64)
        token[place] = tokens
        for joins in levels:
            token = joined(symbols, token, joins, merges, window)
        place = np.flatnonzero(token >= 0)
        tokens = token[place]
    return tokens, np.searchsorted(place, first)


def _representatives(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each kind of span, and the kind of every span: equal bytes, not only equal hashes."""
    _, sample, which = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
    size = end - start
    own = start[sample][which]
    differs = size != size[sample][which]
    upto = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
    there = np.minimum(np.repeat(own, size) + step, len(data) - 1)
    unlike = data[np.repeat(start, size) + step] != data[there]
    differs[np.searchsorted(upto, np.flatnonzero(unlike), side="right") - 1] = True
    single = np.flatnonzero(differs)
    which[single] = len(sample) + np.arange(len(single))
    return np.concatenate([sample, single]), which


def _plain(texts: list[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts without added tokens end to end, and where each text's begin."""
    # A final sigma is lowered like any other, code point by code point.
    own = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() if t else "" for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in own], dtype=np.int64)])
    # A line end between texts belongs to no piece.
    whole = "\n".join([*own, ""])
    points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
    if not len(points):
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    start, end = piece_bounds(points)
    size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
    byte = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(whole.encode("utf-8"), dtype=np.uint8)
    sample, which = _representatives(data, byte[start], byte[end])
    low, high = byte[start[sample]], byte[end[sample]]
    first = np.concatenate([[0], np.cumsum(high - low)])
    source = np.arange(first[-1]) + np.repeat(low - first[:-1], high - low)
    symbols = merges.byte[data[source]]
    symbols[first[1:] - 1] = merges.last[data[high - 1]]
    tokens, at = encode_sequences(symbols, first, merges)
    place, count = ragged(at, which)
    upto = np.concatenate([[0], np.cumsum(count)])
    return tokens[place], upto[np.searchsorted(start, bounds)]


def encode(texts: list[str | None], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's begin (one more: the end).

    Added tokens are found in the texts as they are, before normalising.
    """
    parts = [merges.mark.split(t) if t and merges.mark else [t or ""] for t in texts]
    ids, first = _plain([p for own in parts for p in own[::2]], merges)
    after = np.array([merges.added[p] for own in parts for p in own[1::2]], dtype=np.int64)
    marks = np.array([len(own) // 2 for own in parts], dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(marks)])
    # Part k of text i ends before its k-th added token; its last part has none after it.
    last = np.cumsum(marks + 1)
    bounds = first[np.concatenate([[0], last])] + upto
    if len(after):
        ended = np.delete(np.arange(1, len(first)), last - 1)
        ids = np.insert(ids, first[ended], after)
    return ids, bounds


def decode(ids: np.ndarray, first: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of each text's token strings, joined by one space; and where each text's begin."""
    place, size = ragged(merges.offset, ids)
    # A space follows every token but the last of its text.
    gap = np.ones(len(ids), dtype=np.int64)
    gap[first[1:][first[1:] > first[:-1]] - 1] = 0
    end = np.cumsum(size + gap)
    out = np.full(end[-1] if len(end) else 0, 0x20, dtype=np.uint8)
    target = np.arange(len(place)) + np.repeat((end - size - gap) - (np.cumsum(size) - size), size)
    out[target] = merges.text[place]
    return out, np.concatenate([[0], end])[first]


_parsed: dict[str, Merges] = {}


def encoded(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """For every row of ``docs``: ``row``, ``ids`` (array of int) and ``decoded`` (string).

    Ids are those of the tokenizers library in its default setting, without special
    tokens added; ``decoded`` is what it gives back for them, special tokens included.
    ``row`` holds the columns ``keep`` (all, if not given) as a struct, so their names
    cannot clash. A null or empty text has no ids and decodes to an empty string; equal
    texts get equal ids; an empty table gives no rows; a very long text is worked on
    alone, its unsplit pieces as trees. ``path`` names a tokenizer file on the driver;
    its text is sent to the tasks.
    """
    with open(path, encoding="utf-8") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = frames.packed(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if raw.value not in _parsed:
            _parsed[raw.value] = parse(raw.value)
        merges = _parsed[raw.value]
        for batch in batches:
            for lo, hi, _ in chunks(texts_of(batch.column(1))):
                ids, first = encode(batch.column(1).slice(lo, hi - lo).to_pylist(), merges)
                text, at = decode(ids, first, merges)
                offsets = pa.py_buffer(at.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))),
                        pa.Array.from_buffers(pa.string(), hi - lo, [None, offsets, pa.py_buffer(text.tobytes())]),
                    ],
                    names=["row", "ids", "decoded"],
                )

    return rows.mapInArrow(run, frames.with_row(rows, "ids array<int>, decoded string"))
