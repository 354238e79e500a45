"""Several sources as one feed, a failing source kept apart."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.operators import mapping
from sift.params import DEFAULT_SOURCE, Board
from sift.schema import POSTING
from sift.sources.boards import boards_frame, boards_table, join_boards, with_ingest_seq
from sift.sources.payloads import job_rows

log = logging.getLogger("sift")

#: Names of sources up to so many, a few megabytes, are broadcast.
MAX_BROADCAST_SOURCES = 100_000

DROP_SOURCE = "drop_source"
QUARANTINE = "quarantine"


@dataclass(frozen=True)
class Source:
    """A named feed. ``load`` gives posting columns and a ``reject`` column."""

    name: str
    load: Callable[[SparkSession, int], DataFrame]


def board_source(
    landed: Callable[[SparkSession], DataFrame],
    boards: Sequence[Board] | DataFrame,
    name: str = DEFAULT_SOURCE,
) -> Source:
    """Landed payloads of the given boards, a list or a table, as a source.

    With a table, give ``landed`` no list of boards: the join prunes the folders.
    """

    def load(spark: SparkSession, source_ord: int) -> DataFrame:
        frame = boards_table(boards) if isinstance(boards, DataFrame) else boards_frame(spark, boards)
        payloads = join_boards(landed(spark), frame)
        jobs = with_ingest_seq(job_rows(payloads), source_ord)
        return mapping.map_jobs(jobs, name)

    return Source(name, load)


def union_sources(batches: Sequence[DataFrame]) -> DataFrame:
    """Append batches; columns one of them lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def load_sources(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """All sources in order; one whose plan cannot be built is logged and left out."""
    batches = []
    for source_ord, source in enumerate(sources):
        try:
            batches.append(source.load(spark, source_ord))
        except Exception as error:  # whatever a source raises concerns that source only
            log.error("Collector %s failed: %s", source.name, error)
    if batches:
        return union_sources(batches)
    return spark.createDataFrame([], T.StructType([*POSTING, T.StructField("reject", T.StringType())]))


def without_sources(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of sources that are not in ``bad`` (one row per source).

    Up to ``MAX_BROADCAST_SOURCES`` names are fetched and broadcast, so a feed with one
    source is never shuffled by its name, and its bad sources are found once.
    """
    names = bad.limit(MAX_BROADCAST_SOURCES + 1).collect()
    if len(names) <= MAX_BROADCAST_SOURCES:
        bad = F.broadcast(rows.sparkSession.createDataFrame(names, "source string"))
    return rows.join(bad, "source", "left_anti").select(*rows.columns)


def isolate_sources(mapped: DataFrame, on_bad: str = DROP_SOURCE) -> DataFrame:
    """Postings of sound sources.

    ``drop_source`` leaves out every row of a source that has one reject;
    ``quarantine`` leaves out the rejects only. The bad sources are found with a
    map-side distinct, so what reaches the join is one row per source at most.
    Finding them reads the feed a second time; ``plans.batch.run_feed`` gets by
    with one reading.
    """
    good = mapping.postings(mapped)
    if on_bad == QUARANTINE:
        return good
    if on_bad != DROP_SOURCE:
        raise ValueError(f"unknown handling of bad rows: {on_bad}")
    bad = mapped.where(F.col("reject").isNotNull()).select("source").distinct()
    return without_sources(good, bad)
