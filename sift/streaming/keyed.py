"""The seen state as keyed state of a stream, for intervals too short for a log each.

Every fingerprint has a value in the stream's state store: when it was first and last seen,
its score and what describes it. A micro-batch touches the keys it brings and no others,
so its cost does not grow with the state, and the checkpoint restores it. The rows that
come out are the touched keys as they stand, with what the first sighting of the batch was
and whether it was new; a sink can route them, or keep the newest row of each key.

Repeats are folded in their task before they move, so a fingerprint with a third of the
rows is a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sift.operators import mapping
from sift.operators.dedup import KEY
from sift.params import DEFAULT_SOURCE, Board
from sift.plans.batch import Scorer
from sift.sources.collect import board_source
from sift.sources.payloads import stream_payload_files

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_DESCRIBED = ("source", "company", "title", "url")
_SIGHTING = f"{KEY} string, now timestamp, first_at string, last_at string, first_score int, last_score int, source string, company string, title string, url string"
_STATE = "first_seen timestamp, last_seen timestamp, score int, source string, company string, title string, url string"
_OUT = f"{KEY} string, {_STATE}, first_score int, is_new boolean"


def arrival() -> Column:
    """``ingest_seq`` as a text that sorts like it."""
    seq = F.col("ingest_seq")
    number = lambda name, digits: F.lpad(F.coalesce(seq[name], F.lit(0)).cast("string"), digits, "0")
    return F.concat_ws("\u0001", number("source_ord", 10), number("board_ord", 10), seq["landed"], number("landed_pos", 19), number("pos", 10))


def folded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a fingerprint of each Arrow batch: its first and its last sighting."""
    for part in parts:
        if not len(part):
            continue
        by = part.sort_values("first_at", kind="stable").groupby(KEY, sort=False)
        first, last = by.head(1).set_index(KEY), by.tail(1).set_index(KEY)
        first["last_at"], first["last_score"] = last["last_at"], last["last_score"]
        yield first.reset_index()[part.columns.tolist()]


class Seen(StatefulProcessor):
    """Touches or inserts a key, as a batch of the log does."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("seen", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = last = None
        for row in rows:
            first = row if first is None or row.first_at < first.first_at else first
            last = row if last is None or row.last_at > last.last_at else last
        known = self.value.get()
        if known is None:
            state = (first.now, first.now, last.last_score, *(first[c] for c in _DESCRIBED))
        else:
            state = (known[0], first.now, last.last_score, *tuple(known)[3:])
        self.value.update(state)
        names = [f.split()[0] for f in _OUT.split(", ")]
        yield Row(**dict(zip(names, (key[0], *state, first.first_score, known is None))))

    def close(self) -> None:
        pass


def seen_changes(spark: SparkSession, landing: str, boards: Sequence[Board], scorer: Scorer, source: str = DEFAULT_SOURCE, max_files: int | None = None) -> DataFrame:
    """A stream of touched keys: the state's columns, ``first_score`` and ``is_new``.

    Rejects are left out one by one (``quarantine``): what a whole source brought is not
    known before its rows move on. The state store must be RocksDB; the setting is made
    here, as the plain one has no keyed values.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    landed = stream_payload_files(spark, landing, max_files)
    posts = mapping.postings(board_source(lambda _: landed, boards, source).load(spark, 0))
    rows = scorer(posts).withColumns({"first_at": arrival(), "now": F.current_timestamp()})
    rows = rows.select(KEY, "now", "first_at", F.col("first_at").alias("last_at"), F.col("score").alias("first_score"), F.col("score").alias("last_score"), *_DESCRIBED)
    keyed = rows.mapInPandas(folded, _SIGHTING).groupBy(KEY)
    return keyed.transformWithState(statefulProcessor=Seen(), outputStructType=_OUT, outputMode="Update", timeMode="None")


def newest(changes: DataFrame) -> DataFrame:
    """The state from the rows that came out: the newest of each key."""
    columns = [c for c in changes.columns if c not in (KEY, "first_score", "is_new")]
    last = F.max_by(F.struct(*columns), F.col("last_seen")).alias("s")
    return changes.groupBy(KEY).agg(last).select(KEY, "s.*")
