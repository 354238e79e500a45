"""The run as a stream of landed files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sift.params import DEFAULT_SOURCE, Board, Thresholds
from sift.plans.batch import Scorer, Sink, run_feed
from sift.session import shared_folder
from sift.sources.collect import DROP_SOURCE, board_source
from sift.sources.payloads import stream_payload_files
from sift.state.seen import SeenStore


def _utc_now(batch_id: int) -> datetime:
    return datetime.now(timezone.utc)


def start_feed(
    spark: SparkSession,
    landing: str,
    boards: Sequence[Board],
    scorer: Scorer,
    store: SeenStore,
    thresholds: Thresholds = Thresholds(),
    sink: Sink | None = None,
    checkpoint: str | None = None,
    clock: Callable[[int], datetime] = _utc_now,
    on_bad: str = DROP_SOURCE,
    source: str = DEFAULT_SOURCE,
    max_files: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Run every micro-batch of landed files through ``run_feed``.

    Everything that has landed is one batch, unless ``max_files`` cuts it into several;
    each of them is then a run of its own, with its own digest cap.
    A micro-batch that is tried again is given the batch id of its first try and
    so overwrites its own traces; streams and runs by hand can share a store. The
    checkpoint folder is the name of the feed. The default trigger takes what has landed and stops.
    """
    folder = checkpoint or shared_folder(spark)
    if folder is None:
        raise ValueError("give a checkpoint folder or set spark.checkpoint.dir")
    where = checkpoint or f"{folder}/sift-feed"

    def process(landed: DataFrame, feed_batch: int) -> None:
        batch = store.begin(feed=where, feed_batch=feed_batch)
        mapped = board_source(lambda _: landed, boards, source).load(landed.sparkSession, 0)
        now = clock(batch.batch_id)
        run_feed(mapped, scorer, store, batch, now, thresholds, sink, on_bad)

    landed = stream_payload_files(spark, landing, max_files)
    writer = landed.writeStream.foreachBatch(process).option("checkpointLocation", where)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
