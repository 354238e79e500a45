"""Alerts in two phases: whatever fails or runs twice, each is handed out once."""

from __future__ import annotations

import pathlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_runs import clock, given_scores, letters, store, text_of  # noqa: F401

from sift.params import Thresholds
from sift.plans import outbox
from sift.plans.batch import run_batch, text_sink
from sift.plans.outbox import OutboxWriter, outbox_sink, report_of, write_outbox


def task(monkeypatch, partition, attempt):
    given = SimpleNamespace(partitionId=lambda: partition, taskAttemptId=lambda: attempt)
    monkeypatch.setattr(outbox, "TaskContext", SimpleNamespace(get=lambda: given))


def lines(*texts):
    return iter([{"text": t, "is_alert": int(t != "head")} for t in texts])


def staged(path):
    return sorted(p.name for p in pathlib.Path(path).glob("staged/*/*"))


def test_a_task_that_fails_after_writing_hands_out_nothing_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    writer = OutboxWriter(path, 3, "run")
    task(monkeypatch, 0, 10)
    first = writer.write(lines("head", "a", "b"))
    # The second task dies once its lines are written, and is run again; so is a slow one.
    task(monkeypatch, 1, 11)
    writer.write(lines("c", "d"))
    task(monkeypatch, 1, 12)
    second = writer.write(lines("c", "d"))
    assert len(staged(path)) == 3 and report_of(spark, path, 3) == ""
    writer.commit([second, None, first])
    assert report_of(spark, path, 3) == "head\na\nb\nc\nd\n"
    assert outbox._published(*outbox._opened(path), 3)["n_alerts"] == 4


def test_a_run_that_fails_leaves_the_earlier_report(spark, letters, store, tmp_path):  # noqa: F811
    path, limits = str(tmp_path / "out"), Thresholds()
    run_batch(letters("A:90 B:70 C:95"), given_scores, store, 0, clock(0), limits, outbox_sink(path, limits))
    before = report_of(spark, path, 0)
    assert before.count("[ 9") == 2 and before.count("[ 70]") == 1
    routed = store.routed_of(0)
    broken = routed.withColumn("title", F.when(F.col("fingerprint") == "C", F.raise_error(F.lit("killed"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="killed"):
        write_outbox(broken, limits, path, 0)
    assert report_of(spark, path, 0) == before and len({p.parent for p in pathlib.Path(path).glob("staged/*/*")}) == 1
    # Run again, the batch has one report, and nothing of the earlier one is left.
    write_outbox(routed, limits, path, 0)
    assert report_of(spark, path, 0) == before and len({p.parent for p in pathlib.Path(path).glob("staged/*/*")}) == 1


def test_the_report_is_that_of_the_text_sink(spark, letters, store, tmp_path):  # noqa: F811
    path, other, limits = str(tmp_path / "out"), str(tmp_path / "text"), Thresholds(digest_max_items=2)
    words = " ".join(f"{c}:{70 + n}" for n, c in enumerate("KLMNOPQRSTUVWXYZABCDEFGHIJ"))
    run_batch(letters(words), given_scores, store, 0, clock(0), limits, outbox_sink(f"file://{path}", limits))
    text_sink(other, limits)(store.routed_of(0), 0)
    assert report_of(spark, path, 0) == text_of(f"{other}/batch_id=0") != ""
    # No rows, no report lines.
    run_batch(letters("K:99"), given_scores, store, 1, clock(1), limits, outbox_sink(path, limits))
    assert report_of(spark, path, 1) == "" and report_of(spark, path, 7) == ""
