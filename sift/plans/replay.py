"""Many batches folded at once.

Running batch after batch over a long history re-reads a growing state each
time. The outcome of all of them is also one aggregate: the first occurrence
over (batch, arrival) is the only new one, the last gives the score.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sift.operators.routing import DIGEST, INSTANT, route_name
from sift.params import Thresholds
from sift.session import working_folder

#: One cutoff is about a hundred bytes; so many batches are broadcast at most.
MAX_BROADCAST_BATCHES = 100_000


def fold_batches(scored: DataFrame, keep: Sequence[str], order: str = "ingest_seq") -> DataFrame:
    """One row per fingerprint over all batches.

    Needs ``batch_id``, ``now``, ``score``, ``fingerprint`` and the order column.
    """
    place = F.struct("batch_id", order)
    columns = ["batch_id", order, "score", *keep]
    folded = scored.groupBy("fingerprint").agg(
        F.min("now").alias("first_seen"),
        F.max("now").alias("last_seen"),
        F.max_by("score", place).alias("score"),
        F.min_by(F.struct(*columns), place).alias("_first"),
    )
    return folded.select(
        "fingerprint", "first_seen", "last_seen", "score",
        F.col("_first.batch_id").alias("first_batch"),
        F.col("_first.score").alias("first_score"),
        *[F.col(f"_first.{c}").alias(c) for c in (order, *keep)],
    )


def digest_cutoffs(
    folded: DataFrame, thresholds: Thresholds, order: str = "ingest_seq"
) -> DataFrame:
    """Per batch, the arrival of the last digest item that is still under the cap.

    The rank is limited on the map side before the shuffle, so a batch that
    holds most rows sends a handful of them per task.
    """
    score = F.col("first_score")
    digest = folded.where(route_name(score, thresholds) == DIGEST)
    in_batch = Window.partitionBy("first_batch").orderBy(order)
    ranked = digest.select("first_batch", order, F.row_number().over(in_batch).alias("_rank"))
    capped = ranked.where(F.col("_rank") <= thresholds.digest_max_items)
    return capped.groupBy("first_batch").agg(F.max(order).alias("_cutoff"))


def with_alerts(
    folded: DataFrame,
    thresholds: Thresholds,
    order: str = "ingest_seq",
    n_batches: int | None = None,
) -> DataFrame:
    """Add ``route``, and ``notified`` for the rows that were alerted.

    The cutoffs hold one row per batch. Where ``n_batches`` bounds them by
    ``MAX_BROADCAST_BATCHES`` they are broadcast, so that no row of the state is shuffled
    by its batch. ``folded`` is read twice: give it a written table when folding is
    the expensive part.
    """
    routed = folded.withColumn("route", route_name(F.col("first_score"), thresholds))
    cutoffs = digest_cutoffs(folded, thresholds, order)
    if n_batches is not None and n_batches <= MAX_BROADCAST_BATCHES:
        cutoffs = F.broadcast(cutoffs)
    joined = routed.join(cutoffs, "first_batch", "left")
    in_digest = (F.col("route") == DIGEST) & (F.col(order) <= F.col("_cutoff"))
    notified = F.coalesce((F.col("route") == INSTANT) | in_digest, F.lit(False))
    return joined.withColumn("notified", notified).drop("_cutoff")


def replay_state(
    scored: DataFrame, thresholds: Thresholds, keep: Sequence[str], order: str = "ingest_seq"
) -> DataFrame:
    """The seen state after all batches, with the notified flag.

    The fold is written to the shared folder, one narrow row a fingerprint, and read from
    there for the batches' number, the digest cutoffs and the state; so ``scored`` is read
    and folded once.
    """
    spark = scored.sparkSession
    folded = fold_batches(scored, keep, order)
    path = f"{working_folder(spark)}/replay-{uuid.uuid4().hex}"
    folded.write.parquet(path)
    folded = spark.read.schema(folded.schema).parquet(path)
    n_batches = folded.select("first_batch").distinct().count()
    return with_alerts(folded, thresholds, order, n_batches)
