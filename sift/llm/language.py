"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of slots holds the filters of all languages: bit l of a slot belongs to
language l. An n-gram is hashed to a few slots, and the bits that all of them share
name every language that contains it, for one lookup. How many n-grams of a text
carry a language's bit, less those expected from false positives of its filter,
decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.llm import frames
from sift.llm.byte_bpe import LETTER, code_point_classes
from sift.llm.words import Texts, chunks, mix, texts_of

GRAMS = (3, 4)
SLOTS_LOG2 = 19
HASHES = 3
#: Labelled documents per language that the filters are learned from at most, whole.
DOCS_PER_LANGUAGE = 1000
#: An n-gram enters a filter if its share there is this large, and not this many
#: times smaller than its largest share in any language.
LEAST_SHARE = 2e-6
LEAST_RATIO = 0.1
UNKNOWN = "und"

_U = np.uint64


def grams_of(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every size of n-grams their hashes, and where those of each text begin (one more: the end).

    Texts are lower-cased; what lies between two words is one boundary, and an n-gram
    has boundaries at its ends only.
    """
    data = texts.data.tobytes()
    own = [data[s:e].decode("utf-8").lower() for s, e in zip(texts.start.tolist(), texts.end.tolist())]
    points = np.frombuffer("\0".join(["", *own, ""]).encode("utf-32-le"), dtype=np.uint32)
    letter = code_point_classes()[points] == LETTER
    before = np.append(letter[1:], False) & ~letter
    place = np.flatnonzero(letter | before)
    value = np.append(np.where(letter[place], points[place], 0), 0).astype(np.uint64)
    begin = np.cumsum([1, *(len(t) + 1 for t in own)])
    out = []
    for n in GRAMS:
        count = max(0, len(value) - n + 1)
        h = np.full(count, mix(np.array([n], dtype=np.uint64))[0])
        inner = np.ones(count, dtype=bool)
        for k in range(n):
            h = h * _U(0x9E3779B97F4A7C15) + value[k : k + count]
            if 0 < k < n - 1:
                inner &= value[k : k + count] > 0
        # The second of its characters is always a letter, and in the n-gram's text.
        at = place[1 : 1 + count][inner[: max(0, len(place) - 1)]] if count else place[:0]
        out.append((mix(h[inner][: len(at)]), np.searchsorted(at, begin)))
    return out


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    """The slots of each hash, by double hashing."""
    step = mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)) | _U(1)
    return [((hashes + _U(k) * step) >> _U(64 - SLOTS_LOG2)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """``bits[slot, word]`` holds 64 languages a word; ``wrong`` is each filter's false positive rate."""

    languages: list[str]
    bits: np.ndarray
    wrong: np.ndarray

    def counts(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many n-grams of each text are in each language's filter."""
        slots = _slots(hashes)
        out = np.zeros((len(first) - 1, len(self.languages)), dtype=np.int64)
        for word in range(self.bits.shape[1]):
            column = self.bits[:, word]
            mask = column[slots[0]]
            for slot in slots[1:]:
                mask &= column[slot]
            for l in range(word * 64, min(len(self.languages), word * 64 + 64)):
                has = np.concatenate([[0], np.cumsum((mask >> _U(l % 64)) & _U(1), dtype=np.int64)])
                out[:, l] = has[first[1:]] - has[first[:-1]]
        return out

    def predict(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's language (-1: no letter) and its score."""
        grams = grams_of(texts)
        total = np.sum([np.diff(first) for _, first in grams], axis=0)
        found = np.sum([self.counts(hashes, first) for hashes, first in grams], axis=0)
        share = np.maximum(found - total[:, None] * self.wrong, 0) / (1 - self.wrong) / np.maximum(total, 1)[:, None]
        best = share.argmax(axis=1) if len(self.languages) else np.zeros(len(total), dtype=np.int64)
        score = np.minimum(share.max(axis=1), 1.0) if len(self.languages) else np.zeros(len(total))
        lettered = (total > 0) & (len(self.languages) > 0)
        return np.where(lettered, best, -1), np.where(lettered, score, 0.0)


def _filters(grams: dict[str, np.ndarray]) -> Filters:
    """Filters that hold the given n-grams of each language; languages in order of their names."""
    languages = sorted(grams)
    bits = np.zeros((1 << SLOTS_LOG2, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    wrong = np.zeros(len(languages))
    for l, language in enumerate(languages):
        bit = _U(1) << _U(l % 64)
        for slot in _slots(grams[language]):
            bits[slot, l // 64] |= bit
        wrong[l] = ((bits[:, l // 64] & bit) > 0).mean() ** HASHES
    return Filters(languages, bits, wrong)


def learn(samples: dict[str, Texts]) -> Filters:
    """Filters from the texts of every language."""
    shares = {}
    for language, texts in samples.items():
        hashes = np.concatenate([h for h, _ in grams_of(texts)])
        key, count = np.unique(hashes, return_counts=True)
        shares[language] = (key, count / max(1, len(hashes)))
    every = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(key for key, _ in shares.values())]))
    most = np.zeros(len(every))
    for key, share in shares.values():
        at = np.searchsorted(every, key)
        most[at] = np.maximum(most[at], share)
    return _filters({l: k[(s >= LEAST_SHARE) & (s >= LEAST_RATIO * most[np.searchsorted(every, k)])] for l, (k, s) in shares.items()})


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: a fifth, by the checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of each group, those with the smallest hash of ``doc_id``; ``at`` numbers them.

    Rows are counted first. Hashes that are too large to be among the smallest are left out
    where they are read, so the task of a group sorts a few thousand rows, whatever the
    group's share of the table or the number of tasks. There are few groups.
    """
    counted = rows.groupBy(group).agg(F.count("*").alias("_n"))
    sizes = F.broadcast(rows.sparkSession.createDataFrame(counted.collect(), counted.schema))
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + F.lit(0.5)
    few = rows.join(sizes, group).where(place <= F.lit(4.0 * limit) / F.col("_n")).drop("_n")
    own = Window.partitionBy(group).orderBy(F.xxhash64("doc_id"), "doc_id")
    return few.distinct().withColumn("at", F.row_number().over(own)).where(F.col("at") <= limit)


def _gram_counts(rows: DataFrame) -> DataFrame:
    """``lang, gram, n``: how often each n-gram occurs in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in chunks(texts_of(batch.column(1))):
                names = batch.column(0).slice(lo, hi - lo).dictionary_encode()
                text = names.indices.to_numpy()
                for hashes, first in grams_of(part):
                    language = np.repeat(text, np.diff(first))
                    for l, name in enumerate(names.dictionary.to_pylist()):
                        key, n = np.unique(hashes[: len(language)][language == l], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame) -> Filters:
    """Filters from ``text`` and non-null ``lang`` of rows that are not held out.

    At most ``DOCS_PER_LANGUAGE`` documents of a language are read, whole, those with the
    smallest hash of their id. Their n-grams are counted by tasks; what reaches the driver
    are the n-grams of each filter, at most one over ``LEAST_SHARE`` a language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    chosen = sampled(known, "lang", DOCS_PER_LANGUAGE).select("doc_id", "lang")
    rows = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id")
    rows = rows.agg(F.max(F.col("text").cast("string")).alias("text"))
    frames.bound_batches(docs.sparkSession)
    counts = frames.stored(_gram_counts(rows), frames.scratch(docs.sparkSession), "grams", few=True)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    kept = shares.where(F.col("share") >= LEAST_SHARE).join(most, "gram").where(F.col("share") >= F.lit(LEAST_RATIO) * F.col("most"))
    # One without n-grams is a language all the same.
    grams: dict[str, list[int]] = {row["lang"]: [] for row in chosen.select("lang").distinct().collect()}
    for row in kept.select("lang", "gram").toLocalIterator():
        grams[row["lang"]].append(row["gram"])
    return _filters({language: np.array(own, dtype=np.int64).view(np.uint64) for language, own in grams.items()})


def identified(docs: DataFrame, filters: Filters, keep: list[str] | None = None) -> DataFrame:
    """For every row of ``docs``: ``row``, ``lang_pred`` and ``score`` (0 to 1), from ``text`` alone.

    ``row`` holds the columns ``keep`` (all, if not given) as a struct, so their names
    cannot clash. A text that is null or has no letter is ``und`` with score 0. Of equal
    counts the language first by name wins; equal texts get equal results; an empty
    table gives no rows.
    """
    names = np.array([*filters.languages, UNKNOWN], dtype=object)

    def fn(texts: Texts) -> list[pa.Array]:
        best, score = filters.predict(texts)
        return [pa.array(names[best], pa.string()), pa.array(score)]

    return frames.annotated(docs, keep or docs.columns, "text", fn, "lang_pred string, score double")
