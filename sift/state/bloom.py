"""Bloom filters of merged state, one a bucket, as a small table beside it.

A key belongs to one block of its bucket's filter: four words of 64 bits, in each of
which it sets two bits. The table has one row a block, about a byte and a half a key, so
asking it which keys of a batch may be known reads a tenth of the keys themselves. A key
that misses a bit is new; the buckets of such keys need not be opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.operators.dedup import KEY

#: Keys a block is made for: 11 bits a key, about one false answer in a hundred.
KEYS_PER_BLOCK = 24
WORDS = 4


def blocks_for(n_keys: int, buckets: int) -> int:
    """Blocks of each bucket's filter."""
    return max(1, -(-n_keys // (buckets * KEYS_PER_BLOCK)))


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket that a table clustered by the key has for it."""
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bits of a key in each word of its block."""
    spread = F.xxhash64(key, F.lit("bits"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)).alias(f"w{w}") for w in range(WORDS)]


def placed(keys: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """Keys with their bucket, block and bits."""
    key = F.col(KEY)
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")
    return keys.select(KEY, bucket_of(key, buckets).alias("bucket"), block, *_bits(key))


def filters(keys: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """``bucket, block, w0 ..``: the filters of all keys, combined on the map side first."""
    words = [F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]
    return placed(keys, buckets, blocks).groupBy("bucket", "block").agg(*words)


def perhaps_known(keys: DataFrame, table: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """Those of a small set of keys that the filters do not exclude.

    The keys are broadcast and the table is read in place; the caller proves their number.
    """
    asked = placed(keys, buckets, blocks).select(KEY, "bucket", "block", *[F.col(f"w{w}").alias(f"k{w}") for w in range(WORDS)])
    met = table.join(F.broadcast(asked), ["bucket", "block"])
    has = [F.col(f"w{w}").bitwiseAND(F.col(f"k{w}")) == F.col(f"k{w}") for w in range(WORDS)]
    return met.where(reduce(Column.__and__, has)).select(KEY)
