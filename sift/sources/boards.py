"""The board dimension and its join with landed payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.params import Board

_BOARD_COLUMNS = "token string, company string, board_ord int"


# A board is two short strings; this many are a few tens of megabytes at most.
MAX_BROADCAST_BOARDS = 100_000


def boards_frame(spark: SparkSession, boards: Sequence[Board]) -> DataFrame:
    """Boards in their configured order; repeats are kept, none gives no rows.

    The list is counted here, where its length is known: a short one is marked
    for broadcast, so that payload bodies are never shuffled to find their
    board, and a long one is left to the optimizer.
    """
    rows = [(b.token, b.company, ord_) for ord_, b in enumerate(boards)]
    frame = spark.createDataFrame(rows, _BOARD_COLUMNS)
    return F.broadcast(frame) if len(rows) <= MAX_BROADCAST_BOARDS else frame


def boards_table(table: DataFrame) -> DataFrame:
    """Boards kept as a table with ``token, company, board_ord``, however many.

    A board without a company has its token's name; one without a place in the order is not
    collected. As the table is a filtered one, its join with landed folders prunes these
    when the query runs: tokens are not put into the plan. It is broadcast only where it
    was counted to be short, and the pruning needs that.
    """
    listed = table.where(F.col("board_ord") >= 0)
    named = listed.select("token", F.coalesce("company", "token").alias("company"), F.col("board_ord").cast("int").alias("board_ord"))
    few = named.limit(MAX_BROADCAST_BOARDS + 1).count() <= MAX_BROADCAST_BOARDS
    return F.broadcast(named) if few else named


def join_boards(payloads: DataFrame, boards: DataFrame) -> DataFrame:
    """Payloads of configured boards, once per time a board is listed."""
    return payloads.join(boards, "token")


def with_ingest_seq(jobs: DataFrame, source_ord: int = 0) -> DataFrame:
    seq = F.struct(
        F.lit(source_ord).alias("source_ord"),
        F.col("board_ord").alias("board_ord"),
        F.col("landed").alias("landed"),
        F.col("landed_pos").alias("landed_pos"),
        F.col("pos").alias("pos"),
    )
    return jobs.withColumn("ingest_seq", seq)
