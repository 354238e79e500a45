"""One run: score, remember, keep what is new, route, alert, mark.

The raw feed is read once. Its first action writes one narrow row per
fingerprint to a log, which cuts the lineage; everything after it reads logs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sift.operators.dedup import KEY, batch_summary
from sift.operators.mapping import has_required_fields
from sift.operators.routing import alerted, route
from sift.operators.scoring import score
from sift.params import RuleSet, Thresholds
from sift.plans.sink import write_alerts
from sift.schema import ALERT_FIELDS
from sift.sources.collect import DROP_SOURCE, QUARANTINE, without_sources
from sift.state.seen import Batch, SeenStore

Scorer = Callable[[DataFrame], DataFrame]
Sink = Callable[[DataFrame, int], None]

def keyword_scorer(rules: RuleSet) -> Scorer:
    return lambda posts: score(posts, rules)


def text_sink(path: str, thresholds: Thresholds) -> Sink:
    return lambda routed, batch_id: write_alerts(routed, thresholds, path, batch_id)


def run_feed(
    mapped: DataFrame,
    scorer: Scorer,
    store: SeenStore,
    batch_id: int | Batch | None,
    now: datetime,
    thresholds: Thresholds = Thresholds(),
    sink: Sink | None = None,
    on_bad: str = DROP_SOURCE,
    sources: Sequence[str] = (),
) -> DataFrame:
    """Process mapped rows, rejects among them, as one batch.

    Sources that hold a reject are left out without reading the feed twice: the
    rejects travel through the same aggregation, under keys of their own, and the
    narrow result is filtered by them. Under either handling the rejects are kept
    with their reasons, the first of each reason and board and how often it came.
    Without a ``batch_id`` the batch takes its place behind all that are committed.
    The rows of the named ``sources`` are counted by the job that writes the batch, and are
    in the ``counts`` of its ``Batch`` afterwards.
    """
    if on_bad not in (DROP_SOURCE, QUARANTINE):
        raise ValueError(f"unknown handling of bad rows: {on_bad}")
    batch = store.begin(batch_id)
    is_bad = F.col("reject").isNotNull()
    scored = scorer(mapped.where(is_bad | has_required_fields()))
    bad_key = F.struct("source", "company", "reject")
    key = F.struct(F.when(~is_bad, F.col(KEY)).alias(KEY), F.when(is_bad, bad_key).alias("bad"))
    summary = batch_summary(scored.withColumn(KEY, key), ALERT_FIELDS)
    summary = summary.select(F.col(f"{KEY}.{KEY}").alias(KEY), F.col(f"{KEY}.bad.reject").alias("reject"), *summary.columns[1:])
    counted = Observation()
    if sources:
        summary = summary.observe(counted, *_source_metrics(sources))
    collected = store.write(summary.withColumn("now", F.lit(now)), "collected", batch)
    if sources:
        batch.counts = _source_counts(counted.get, sources, on_bad)
    bad = collected.where(F.col("reject").isNotNull())
    bad = store.write(bad.select("source", "company", "ingest_seq", "reject", "n_rows"), "rejects", batch)
    sound = collected.where(F.col("reject").isNull()).drop("reject")
    if on_bad == DROP_SOURCE:
        sound = without_sources(sound, bad.select("source").distinct())
    return _after_summary(sound, store, batch, now, thresholds, sink, "rejects")


def _source_metrics(sources: Sequence[str]) -> list[Column]:
    """Postings and rejects of each source, as metrics of the job that writes them.

    The rows are those behind the aggregation, so a task that is run again after a loss is
    counted once.
    """
    metrics = []
    for n, name in enumerate(sources):
        for kind, wanted in (("posts", F.col("reject").isNull()), ("rejects", F.col("reject").isNotNull())):
            rows = F.when((F.col("source") == name) & wanted, F.col("n_rows")).otherwise(0)
            metrics.append(F.coalesce(F.sum(rows), F.lit(0)).alias(f"{kind}_{n}"))
    return metrics


def _source_counts(metrics: dict, sources: Sequence[str], on_bad: str) -> dict[str, tuple[int, int]]:
    """Postings taken in and rejects; a source that failed has none of the former."""
    counts = {}
    for n, name in enumerate(sources):
        posts, rejects = metrics[f"posts_{n}"], metrics[f"rejects_{n}"]
        counts[name] = (0 if rejects and on_bad == DROP_SOURCE else posts, rejects)
    return counts


def count_lines(counts: dict[str, tuple[int, int]]) -> list[str]:
    """The counts as they are printed after a run."""
    return [f"{name}: {posts} posts" + (f", {rejects} rejects" if rejects else "") for name, (posts, rejects) in sorted(counts.items())]


def run_batch(
    posts: DataFrame,
    scorer: Scorer,
    store: SeenStore,
    batch_id: int | Batch | None,
    now: datetime,
    thresholds: Thresholds = Thresholds(),
    sink: Sink | None = None,
) -> DataFrame:
    """Process one batch of postings and return its alerted rows."""
    batch = store.begin(batch_id)
    summary = batch_summary(scorer(posts), ALERT_FIELDS)
    return _after_summary(summary, store, batch, now, thresholds, sink)


def _after_summary(
    summary: DataFrame,
    store: SeenStore,
    batch: Batch,
    now: datetime,
    thresholds: Thresholds,
    sink: Sink | None,
    *logs: str,
) -> DataFrame:
    """Order of effects: remembered, then alerted, then marked, so an alert goes
    out at most once per completed run of a batch id."""
    store.write(summary.withColumn("now", F.lit(now)), "sightings", batch)
    # From here on the batch has its id, and all batches before it are committed.
    store.commit(batch, "sightings", *logs)
    sightings = store.sightings_of(batch.batch_id)

    # Only rows that can be alerted need to be compared with the past. The count
    # reads one column of the log and proves the size of what may be broadcast.
    lowest = min(thresholds.digest, thresholds.instant)
    candidates = sightings.where(F.col("first_score") >= lowest)
    new = store.filter_new(candidates, batch.batch_id, candidates.count())
    routed = route(new.withColumnRenamed("first_score", "score"), thresholds)

    written = store.write(routed, "routed", batch)
    if sink is not None:
        sink(written, batch.batch_id)
    chosen = alerted(written, thresholds)
    store.mark_notified(chosen, batch)
    return chosen


def batch_counts(store: SeenStore, batch_id: int, sources: Sequence[str] = ()) -> DataFrame:
    """Postings per source that the batch took in, repeats included, and its rejects.

    A source that failed, and one of ``sources`` that gave nothing, has a line with zero.
    """
    spark = store.spark
    listed = spark.createDataFrame([(name,) for name in sources], "source string")
    taken = store.sightings_of(batch_id).select("source", F.col("n_rows").alias("n_posts"), F.lit(0).alias("n_rejects"))
    failed = store.rejects_of(batch_id).select("source", F.lit(0), "n_rows")
    none = listed.select("source", F.lit(0), F.lit(0))
    counts = taken.union(failed).union(none).groupBy("source").agg(
        F.sum("n_posts").cast("bigint").alias("n_posts"), F.sum("n_rejects").cast("bigint").alias("n_rejects")
    )
    message = F.format_string("%s: %d posts", F.col("source"), F.col("n_posts"))
    failure = F.format_string(", %d rejects", F.col("n_rejects"))
    return counts.withColumn("message", F.when(F.col("n_rejects") > 0, F.concat(message, failure)).otherwise(message))
