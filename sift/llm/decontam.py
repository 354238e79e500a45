"""Benchmark decontamination with suffix arrays over the training texts.

Every task sorts the word suffixes of a shard of whole documents. Each suffix of the
test items is then searched in that order: at every further word the range of
suffixes that still agree is narrowed by binary search, which gives the longest
verbatim match and, as a range of the array, all of its locations. Nothing is
shuffled; a shard is a piece of one task's input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm import frames
from sift.llm.byte_bpe import ragged
from sift.llm.words import NOT_ALNUM, Texts, chunks, mix, split_words, texts_of

WINDOW = 10
#: Test text held by a task at once; more is searched block after block.
BLOCK_BYTES = 16 << 20

MATCH = "array<struct<item_id:string,item_word:int,word:int,n_words:int>>"
FIELDS = f"n_words bigint, n_hit bigint, items array<string>, matches {MATCH}"


@dataclass
class TestSet:
    """Words of all items, a gap of one zero after each; and the place of every distinct window.

    Entry k says that window ``entry_window[k]`` is in item ``entry_item[k]``, first at word
    ``entry_offset[k]``; entries are in the order of windows, those of window w are
    ``entry_first[w]:entry_first[w + 1]``. ``follows`` has, sorted, entry times number of
    windows plus the window that comes next in the item.
    """

    names: list[str | None]
    words: np.ndarray
    item_first: np.ndarray
    place: np.ndarray
    length: np.ndarray
    entry_window: np.ndarray
    entry_item: np.ndarray
    entry_offset: np.ndarray
    entry_first: np.ndarray
    follows: np.ndarray


def test_set(names: list[str | None], texts: pa.Array, window: int = WINDOW) -> TestSet:
    """Windows of ``window`` words; an item with fewer, but not none, is one window."""
    part = texts_of(texts)
    base = part.start[0] if len(part) else 0
    words = split_words(Texts(part.data[base:], part.start - base, part.end - base), NOT_ALNUM, fold=True)
    count = np.diff(words.first)
    item = np.repeat(np.arange(len(count)), count)
    value = np.zeros(len(words.hash) + len(count), dtype=np.uint64)
    place = np.arange(len(words.hash)) + item
    value[place] = words.hash
    offset = np.arange(len(words.hash)) - words.first[item]
    length = np.minimum(window, count[item])
    whole = offset + length <= count[item]
    item, place, offset, length = item[whole], place[whole], offset[whole], length[whole]
    # Equal windows, of one item or of several, are searched once.
    key = mix(length.astype(np.uint64))
    for k in range(window):
        here = np.where(k < length, value[np.minimum(place + k, len(value) - 1)], 0) if len(value) else key
        key = mix(key + here.astype(np.uint64))
    _, sample, number = np.unique(key, return_index=True, return_inverse=True)
    entry, first, which = np.unique(number * len(names) + item, return_index=True, return_inverse=True)
    entry_window = entry // max(1, len(names))
    goes_on = np.flatnonzero((item[1:] == item[:-1]) & (offset[1:] == offset[:-1] + 1)) if len(item) else item
    return TestSet(
        names, value, words.first + np.arange(len(count) + 1), place[sample], length[sample], entry_window, item[first], offset[first],
        np.searchsorted(entry_window, np.arange(len(sample) + 1)), np.unique(which[goes_on] * len(sample) + number[goes_on + 1]),
    )


def suffix_array(value: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared over at least ``depth`` values.

    Prefix doubling; only suffixes that still tie are sorted again.
    """
    order = np.argsort(value, kind="stable")
    n = len(order)
    slot = np.arange(n)
    head = np.ones(n, dtype=bool)
    head[1:] = value[order[1:]] != value[order[:-1]]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0))
    rank[n] = -1
    seen = 1
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    while seen < depth and len(tied):
        at = order[tied]
        key = rank[at] * (n + 1) + rank[np.minimum(at + seen, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        head = np.append(True, key[1:] != key[:-1])
        fresh = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        rank[at] = fresh
        tied = tied[~(head & np.append(head[1:], True))]
        seen *= 2
    return order


def narrowed(value: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each range whose suffixes have ``word`` at ``depth``."""
    last = len(value) - 1

    def bound(low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            there = value[np.minimum(order[mid] + depth, last)]
            right = there <= word[open_] if after else there < word[open_]
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)

    first = bound(lo, hi, after=False)
    return first, bound(first, hi, after=True)


def occurrences(value: np.ndarray, order: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and the positions in ``value`` where they occur."""
    live = np.arange(len(tests.place))
    sorted_value = value[order]
    word = tests.words[tests.place]
    lo, hi = np.searchsorted(sorted_value, word), np.searchsorted(sorted_value, word, side="right")
    found, starts, ends = [], [], []
    depth = 1
    while True:
        full = lo < hi
        live, lo, hi = live[full], lo[full], hi[full]
        done = tests.length[live] == depth
        found.append(live[done]), starts.append(lo[done]), ends.append(hi[done])
        live, lo, hi = live[~done], lo[~done], hi[~done]
        if not len(live):
            break
        lo, hi = narrowed(value, order, lo, hi, depth, tests.words[tests.place[live] + depth])
        depth += 1
    which, first, count = np.concatenate(found), np.concatenate(starts), np.concatenate(ends)
    count = count - first
    steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(which, count), order[np.repeat(first, count) + steps]


def verbatim(own: np.ndarray, run: np.ndarray, size: int, first: int) -> Iterator[tuple[int, int, int]]:
    """A run as parts of the item ``own``: place there, place in the run, number of words.

    Most runs stand at the first place of their first window. Where an item repeats itself,
    the part that agrees longest is taken, and the next goes on with the next window.
    """

    def agree(there: int, here: int) -> int:
        n = min(len(own) - there, len(run) - here)
        unlike = np.flatnonzero(own[there : there + n] != run[here : here + n])
        return int(unlike[0]) if len(unlike) else n

    here = 0
    while here + size <= len(run):
        there, n = first, agree(first, here) if here == 0 else 0
        if here + n < len(run):
            last = len(own) - size + 1
            same = np.all([own[k : last + k] == run[here + k] for k in range(size)], axis=0)
            n, there = max((agree(p, here), -p) for p in np.flatnonzero(same).tolist())
            there = -there
        yield there, here, n
        here += n - size + 1


def matched(texts: Texts, tests: TestSet) -> tuple[np.ndarray, list[np.ndarray], list[list[dict]]]:
    """Words per text, which of them lie in a window, and the verbatim matches."""
    words = split_words(texts, NOT_ALNUM, fold=True)
    count = np.diff(words.first)
    n = len(count)
    matches: list[list[dict]] = [[] for _ in range(n)]
    if not len(words.hash) or not len(tests.place):
        return count, [np.zeros(c, dtype=bool) for c in count], matches
    doc = np.repeat(np.arange(n), count)
    # One value of its own after each document: no match runs on into the next.
    value = np.empty(len(doc) + n, dtype=np.uint64)
    begin, gap = words.first[:-1] + np.arange(n), words.first[1:] + np.arange(n)
    value[np.arange(len(doc)) + doc] = np.where(words.hash < n, words.hash + np.uint64(n), words.hash)
    value[gap] = np.arange(n, dtype=np.uint64)
    order = suffix_array(value, int(tests.length.max()))
    which, at = occurrences(value, order, tests)
    size = tests.length[which]
    cover = np.zeros(len(value) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    hit = np.cumsum(cover) > 0
    # Every item that has the window: at one place an item has one window at most.
    entry, n_items = ragged(tests.entry_first, which)
    at = np.repeat(at, n_items)
    item = tests.entry_item[entry]
    by = np.lexsort((at, item))
    entry, at, item = entry[by], at[by], item[by]
    window, size = tests.entry_window[entry], tests.length[tests.entry_window[entry]]
    # Windows that follow each other in the text and in the item are one verbatim match.
    step = entry[:-1] * len(tests.place) + window[1:]
    slot = np.minimum(np.searchsorted(tests.follows, step), max(0, len(tests.follows) - 1))
    goes_on = (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1)
    goes_on &= tests.follows[slot] == step if len(tests.follows) else False
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = ~goes_on
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(at)) - 1 if len(head) else head
    inside = np.searchsorted(gap, at[head])
    for a, b, d in zip(head, tail, inside):
        own = tests.words[tests.item_first[item[a]] : tests.item_first[item[a] + 1] - 1]
        run = value[at[a] : at[b] + size[b]]
        for there, here, n in verbatim(own, run, int(size[a]), int(tests.entry_offset[entry[a]])):
            matches[d].append({"item_id": tests.names[item[a]], "item_word": there, "word": int(at[a] - begin[d]) + here, "n_words": n})
    return count, [hit[b:g] for b, g in zip(begin, gap)], matches


_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("word", pa.int32()), ("n_words", pa.int32())]))


def _search(tests: TestSet, last: bool):
    """Search one block of the test set, on top of what earlier blocks found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in chunks(texts_of(batch.column("text"))):
                own = batch.slice(lo, hi - lo)
                count, hits, matches = matched(part, tests)
                if "mask" in own.schema.names:
                    for i, mask in enumerate(own.column("mask").to_pylist()):
                        hits[i] = hits[i] | np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=len(hits[i])).astype(bool)
                    matches = [old + new for old, new in zip(own.column("matches").to_pylist(), matches)]
                items = [sorted({m["item_id"] for m in found if m["item_id"] is not None}) for found in matches]
                n_hit = np.array([h.sum() for h in hits], dtype=np.int64)
                out = {"row": own.column("row"), "n_words": pa.array(count.astype(np.int64)), "n_hit": pa.array(n_hit), "items": pa.array(items, pa.list_(pa.string())), "matches": pa.array(matches, _MATCH_TYPE)}
                if not last:
                    out |= {"text": own.column("text"), "mask": pa.array([np.packbits(h).tobytes() for h in hits], pa.binary())}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def contamination(docs: DataFrame, test: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For every row of ``docs``: ``row``, ``n_words``, ``n_hit``, ``items``, ``matches``.

    ``row`` holds the columns ``keep`` (all, if not given) as a struct, so their names
    cannot clash. ``n_hit`` counts words inside any occurrence of a window of ``test``
    (``item_id, text``), ``items`` has the sorted ids with an occurring window, and
    ``matches`` verbatim matches with their places that hold all of these words, each
    the longest that begins there. A null or empty text
    has no words. Items of null or blank text match nothing; an item without an id is
    found but not named; items of one id count once. Without documents there are no
    rows; without items nothing is hit.

    The test set is a stated query set: it reaches the tasks in blocks of at most about
    ``BLOCK_BYTES`` (one for any usual benchmark), one pass over the texts for each.
    """
    spark = docs.sparkSession
    state = frames.packed(docs, keep)
    items = test.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // BLOCK_BYTES
    folder = frames.scratch(spark) if n_blocks > 1 else ""
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)) == k).collect()
        tests = test_set([r["name"] for r in rows], pa.array([r["text"] for r in rows], pa.string()))
        last = k == n_blocks - 1
        state = state.mapInArrow(_search(tests, last), frames.with_row(state, FIELDS + ("" if last else ", text string, mask binary")))
        if not last:
            state = frames.stored(state, folder, f"block{k}")
    return state


def decontaminated(docs: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no window of ``test``."""
    return contamination(docs, test).where("n_hit = 0").select("row.*")
