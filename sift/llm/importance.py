"""Importance resampling towards a target distribution, on hashed word n-grams.

The words of a document, lower-cased and joined by one space, are scanned once for
their running CRC-32. The CRC is linear over GF(2): the register after ``b`` bytes is
the register after ``a`` bytes moved on by ``b - a`` zero bytes, plus that of the bytes
between. The CRC of any n-gram therefore comes from the two registers at its ends, and
no n-gram is ever built as a string. Its bucket is the CRC modulo the number of buckets.

The buckets of all documents and of the target texts are counted; a bucket's gain is
the logarithm of the ratio of its smoothed frequencies. A document weighs the sum of its
features' gains. Gumbel noise that depends on seed and ``doc_id`` alone turns a top-k by
weight into a draw without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.llm import frames
from sift.llm.words import LOWER, NOT_ALNUM, Texts, chunks, split_words, texts_of

#: Fixed value: the reflected CRC-32 polynomial.
POLYNOMIAL = 0xEDB88320
#: Bytes that one lane of the scan walks through.
LANE = 64
#: Buckets up to so many are counted in arrays and sent to the driver.
MAX_BUCKETS = 1 << 20

_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """The register that each byte leaves behind on an empty one."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return value


BYTE = _byte_table()


def _apply(table: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values on each of the four bytes."""
    out = table[0][value & np.uint32(0xFF)]
    for k in range(1, 4):
        out = out ^ table[k][(value >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def _shift_tables() -> list[np.ndarray]:
    """Maps that move a register on by 1, 2, 4, ... zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    lanes = [byte << np.uint32(8 * k) for k in range(4)]
    tables = [np.stack([BYTE[v & np.uint32(0xFF)] ^ (v >> np.uint32(8)) for v in lanes])]
    for _ in range(31):
        tables.append(np.stack([_apply(tables[-1], _apply(tables[-1], v)) for v in lanes]))
    return tables


SHIFT = _shift_tables()


def shifted(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Registers moved on by ``size`` zero bytes each."""
    value = value.astype(np.uint32, copy=True)
    top = int(size.max()) if len(size) else 0
    for bit in range(top.bit_length()):
        own = np.flatnonzero((size >> bit) & 1)
        value[own] = _apply(SHIFT[bit], value[own])
    return value


@dataclass
class RunningCrc:
    """The register after every prefix of some bytes, kept by lane."""

    local: np.ndarray
    carry: np.ndarray

    def at(self, place: np.ndarray) -> np.ndarray:
        lane, offset = np.divmod(place, LANE)
        return self.local[lane, offset] ^ shifted(self.carry[lane], offset)


def running_crc(data: np.ndarray) -> RunningCrc:
    """One scan; lanes advance side by side and hand their registers on by doubling."""
    lanes = len(data) // LANE + 1
    padded = np.zeros(lanes * LANE, dtype=np.uint32)
    padded[: len(data)] = data
    columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    local = np.zeros((LANE + 1, lanes), dtype=np.uint32)
    for k in range(LANE):
        local[k + 1] = BYTE[(local[k] ^ columns[k]) & np.uint32(0xFF)] ^ (local[k] >> np.uint32(8))
    whole, step = local[LANE].copy(), 0
    while 1 << step < lanes:
        table = SHIFT[step + LANE.bit_length() - 1]
        whole[1 << step :] ^= _apply(table, whole[: -(1 << step)].copy())
        step += 1
    carry = np.zeros(lanes, dtype=np.uint32)
    carry[1:] = whole[:-1]
    return RunningCrc(np.ascontiguousarray(local.T), carry)


@dataclass
class Features:
    """Bucket of every n-gram and the text it is from; words of each text."""

    text: np.ndarray
    bucket: np.ndarray
    n_words: np.ndarray


def features(texts: Texts, max_words: int, buckets: int) -> Features:
    """All runs of 1 to ``max_words`` consecutive words of each text, repeats included."""
    words = split_words(texts, NOT_ALNUM, fold=True)
    n_words = np.diff(words.first)
    if not len(words.start):
        none = np.zeros(0, dtype=np.int64)
        return Features(none, none, n_words)
    # Every word and the space after it; n-grams end before that space.
    edge = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
    owner = np.repeat(np.arange(len(words.start)), np.diff(edge))
    source = np.arange(edge[-1]) - edge[owner] + words.start[owner]
    joined = LOWER[texts.data[np.minimum(source, len(texts.data) - 1)]]
    joined[edge[1:] - 1] = 0x20
    crc = running_crc(joined)
    before = crc.at(edge[:-1]) ^ _ONES
    after = crc.at(edge[1:] - 1)
    text = np.repeat(np.arange(len(n_words)), n_words)
    owners, found = [], []
    for size in range(1, max_words + 1):
        first = np.arange(len(words.start) - size + 1)
        first = first[text[first] == text[first + size - 1]] if size > 1 else first
        last = first + size - 1
        length = edge[last + 1] - 1 - edge[first]
        value = after[last] ^ shifted(before[first], length) ^ _ONES
        owners.append(text[first])
        found.append(value.astype(np.int64) % buckets)
    return Features(np.concatenate(owners), np.concatenate(found), n_words)


def bucket_counts(rows: DataFrame, max_words: int, buckets: int) -> dict[int, int]:
    """How many features of the whole column ``text`` fall into each bucket.

    Tasks count into arrays; a row a bucket and task is shuffled, a row a bucket is
    sent to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, part in chunks(texts_of(batch.column(0))):
                total += np.bincount(features(part, max_words, buckets).bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(run, "bucket bigint, n bigint")
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """1000 times the logarithm of the ratio of smoothed frequencies, rounded down."""
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def gain(bucket: int) -> int:
        s, t = raw.get(bucket, 0), target.get(bucket, 0)
        return math.floor(1000 * math.log((t + 1) * (n_raw + buckets) / ((s + 1) * (n_target + buckets))))

    return np.array([gain(b) for b in range(buckets)], dtype=np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate that depends on ``seed`` and ``doc_id`` alone, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def weighted(docs: DataFrame, target: DataFrame, keep: list[str] | None = None, max_words: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """For every row of ``docs``: ``row``, ``n_words``, ``n_features``, ``weight`` and ``score``.

    ``row`` holds the columns ``keep`` (all, if not given) as a struct, so their names
    cannot clash. A null or empty text, or one without words, has no features and
    weighs 0; equal texts weigh the same, and score the same where their ``doc_id``
    is the same too (a missing id counts as the word ``null``). An empty target or an
    empty table still gives gains, by the smoothing. ``docs`` is read twice, as every
    feature stored would take more than scanning again.
    """
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
    raw = bucket_counts(frames.packed(docs, ["doc_id"]), max_words, buckets)
    wanted = bucket_counts(frames.packed(target, target.columns[:1]), max_words, buckets)
    gain = gains(raw, wanted, buckets)
    row = F.struct(*(F.col(frames.quoted(c)) for c in keep or docs.columns)).alias("row")
    rows = docs.select(row, F.col("text").cast("string").alias("text"), gumbel(F.col("doc_id"), seed).alias("noise"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in chunks(texts_of(batch.column(1))):
                found = features(part, max_words, buckets)
                n = np.bincount(found.text, minlength=hi - lo)
                order = np.argsort(found.text, kind="stable")
                upto = np.concatenate([[0], np.cumsum(gain[found.bucket[order]])])
                last = np.cumsum(n)
                weight = upto[last] - upto[last - n]
                noise = batch.column(2).slice(lo, hi - lo).to_numpy()
                columns = [found.n_words, n, weight, weight + noise]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in columns)],
                    names=["row", "n_words", "n_features", "weight", "score"],
                )

    return rows.mapInArrow(run, frames.with_row(rows, "n_words bigint, n_features bigint, weight bigint, score bigint"))


def resampled(docs: DataFrame, target: DataFrame, keep: list[str] | None = None, percent: int = 10, min_words: int = 20, **parameters) -> DataFrame:
    """``weighted`` rows and ``rank``: 1, 2, 3... by score for the ``percent`` drawn, else null.

    Documents with at least ``min_words`` words take part; equal scores go by ascending
    ``doc_id``, a missing id last. Rows are dealt to ranges of (score, id) and written;
    what a range holds tells where the ranks of the next begin, so no task sorts more
    than its range. Only that one number a range reaches the driver.
    """
    spark = docs.sparkSession
    names = list(dict.fromkeys([*(keep or docs.columns), "doc_id"]))
    folder = frames.scratch(spark)
    # Written first, as the ranges are found by a reading of their own.
    found = frames.stored(weighted(docs, target, names, **parameters), folder, "weighted")
    found = found.withColumn("candidate", F.col("n_words") >= min_words)
    order = [F.col("candidate").desc(), F.col("score").desc(), F.col("row.doc_id").asc_nulls_last()]
    dealt = found.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = frames.stored(dealt, folder, "scored")
    frames.remove(spark, f"{folder}/weighted")
    sizes = dealt.where("candidate").groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    wanted = percent * sum(r["n"] for r in sizes) // 100
    before, first = 0, []
    for r in sizes:
        if before < wanted:
            first.append((r["part"], before))
        before += r["n"]
    drawn = F.broadcast(spark.createDataFrame(first, "part int, before bigint"))
    in_range = Window.partitionBy("part").orderBy(*order)
    ranked = dealt.join(drawn, "part").withColumn("rank", F.col("before") + F.row_number().over(in_range))
    ranked = ranked.withColumn("rank", F.when(F.col("candidate") & (F.col("rank") <= wanted), F.col("rank")))
    rest = dealt.join(drawn, "part", "left_anti").withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["row", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
