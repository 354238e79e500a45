"""Commits of several writers, tries that break off, and filters of merged state."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F
from test_runs import body, clock, given_scores, landing, letters, state_of, store  # noqa: F401

from sift.operators.dedup import KEY, not_known
from sift.params import Board, RuleSet, Thresholds
from sift.plans.batch import batch_counts, count_lines, keyword_scorer, run_batch, run_feed
from sift.sources.collect import board_source, load_sources
from sift.sources.payloads import read_payload_files
from sift.state import bloom
from sift.state.commits import CommitLog, Commits, Conflict
from sift.state.seen import SeenStore


@pytest.fixture
def other(spark, store):  # noqa: F811
    """A second writer on the same folder, with a view of its own."""
    return SeenStore(spark, store.root, buckets=4)


def prepared(store, posts, batch_id=None):  # noqa: F811
    """A try whose sightings are written and not committed."""
    from sift.operators.dedup import batch_summary
    from sift.schema import ALERT_FIELDS

    batch = store.begin(batch_id)
    summary = batch_summary(given_scores(posts), ALERT_FIELDS)
    store.write(summary.withColumn("now", F.lit(clock(batch_id or 0))), "sightings", batch)
    return batch


# ---- the log ------------------------------------------------------------------


@pytest.mark.parametrize("by_rename", [False, True])
def test_a_number_is_created_once(spark, tmp_path, monkeypatch, by_rename):
    log = CommitLog(spark, str(tmp_path / "log"))
    if by_rename:
        monkeypatch.setattr(CommitLog, "_moved", CommitLog._renamed)
    assert log.numbers() == []
    assert log.create(0, {"kind": "first"}) and not log.create(0, {"kind": "second"})
    assert log.read(0) == {"kind": "first"} and log.numbers() == [0]
    assert not list((tmp_path / "log" / "_commits").glob("_draft-*"))


def test_many_writers_lose_no_commit(spark, tmp_path):
    """Eight threads commit five entries each: every number has one, every entry a number."""
    root, decisions, start = str(tmp_path / "log"), [], threading.Barrier(8)

    def write(writer):
        commits = Commits(spark, root)
        start.wait()
        for n in range(5):
            def decide(view, n=n):
                decisions.append((writer, n))
                return {"kind": "reserve", "batch_id": view.newest + 1, "feed": f"w{writer}", "feed_batch": n}

            commits.commit(decide)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    view = Commits(spark, root).refreshed()
    given = sorted(n for feed in view.feeds.values() for n in feed.values())
    assert given == list(range(40)) and view.version == 39
    assert len(decisions) > 40 and len(set(decisions)) == 40


# ---- two writers ----------------------------------------------------------------


def test_the_loser_moves_behind_with_the_files_it_has(letters, store, other):  # noqa: F811
    first, second = prepared(store, letters("A:90 B:70")), prepared(other, letters("A:95 C:72"))
    assert store.state().count() == other.state().count() == 0
    files = store._batch_folders("sightings")
    other.commit(second, "sightings")
    store.commit(first, "sightings")
    assert (second.batch_id, first.batch_id) == (0, 1)
    assert sorted(store._batch_folders("sightings")) == sorted(files)
    # The one behind is new against the one before, whoever began first.
    new = store.filter_new(store.sightings_of(1), 1, 2)
    assert [r.fingerprint for r in new.collect()] == ["B"]
    assert {r.fingerprint for r in other.filter_new(other.sightings_of(0), 0, 2).collect()} == {"A", "C"}
    assert {f: s[0] for f, s in state_of(store).items()} == {"A": 90, "B": 70, "C": 72}


def test_a_lost_race_is_decided_again(letters, store, other, monkeypatch):  # noqa: F811
    """The other writer commits between reading the log and creating the number."""
    mine, theirs = prepared(store, letters("A:90")), prepared(other, letters("A:80"))
    create, raced = CommitLog.create, []

    def late(log, number, entry):
        if log is store._commits.log and not raced:
            raced.append(other.commit(theirs, "sightings"))
        return create(log, number, entry)

    monkeypatch.setattr(CommitLog, "create", late)
    store.commit(mine, "sightings")
    assert (theirs.batch_id, mine.batch_id, mine.tries) == (0, 1, 2)


def test_an_id_given_by_hand_is_refused_once_passed(letters, store, other):  # noqa: F811
    mine = prepared(store, letters("A:90"), 3)
    run_batch(letters("A:90"), given_scores, other, 5, clock(5))
    before = state_of(other)
    with pytest.raises(Conflict):
        store.commit(mine, "sightings")
    assert state_of(store) == before and store.next_batch_id() == 6
    # Begun after the other it is a run of an older batch, which is allowed until merged.
    run_batch(letters("A:70"), given_scores, store, 4, clock(4))
    store.compact(5)
    with pytest.raises(Conflict):
        run_batch(letters("A:70"), given_scores, store, 2, clock(2))
    run_batch(letters("A:70"), given_scores, store, 4, clock(4))


def test_two_runs_at_a_time_alert_once(letters, store, other):  # noqa: F811
    """Threads meet after scoring; each posting is alerted by one of them, in any order."""
    meet, alerted, ids = threading.Barrier(2), [], []

    def scorer(posts):
        meet.wait()
        return given_scores(posts)

    def run(own, words):
        batch = own.begin()
        chosen = run_batch(letters(words), scorer, own, batch, clock(1), Thresholds())
        alerted.extend(r.fingerprint for r in chosen.collect())
        ids.append(batch.batch_id)

    threads = [threading.Thread(target=run, args=a) for a in ((store, "A:90 B:90 C:90"), (other, "B:95 C:75 D:85"))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(alerted) == ["A", "B", "C", "D"] and sorted(ids) == [0, 1]
    state = state_of(store)
    assert set(state) == set("ABCD") and all(s[-1] for s in state.values())


def test_compaction_sees_what_came_in_between(letters, store, other, monkeypatch):  # noqa: F811
    """A batch that is run again while it is merged is merged anew."""
    run_batch(letters("A:90"), given_scores, store, 0, clock(0))
    filters, raced = bloom.filters, []

    def late(*arguments):
        if not raced:
            raced.append(run_batch(letters("A:60 Z:61"), given_scores, other, 0, clock(0)))
        return filters(*arguments)

    monkeypatch.setattr(bloom, "filters", late)
    store.compact(0)
    assert raced and {f: s[0] for f, s in state_of(store).items()} == {"A": 60, "Z": 61}
    assert len(store._folders(store.root, "base_")) == len(store._folders(store.root, "bloom_")) == 1


def test_late_marks_of_a_merged_batch_count(spark, letters, store, other):  # noqa: F811
    batch = store.commit(prepared(store, letters("A:90")), "sightings")
    other.compact(0)
    assert state_of(store)["A"][-1] is False
    store.write(spark.createDataFrame([], store._empty("routed").schema), "routed", batch)
    store.mark_notified(spark.createDataFrame([("A",)], "fingerprint string"), batch)
    assert state_of(store)["A"][-1] is True
    other.expire(0)
    assert state_of(SeenStore(spark, store.root))["A"][-1] is True


# ---- tries that break off ---------------------------------------------------------


def test_a_run_that_breaks_off_leaves_no_trace(spark, letters, store, monkeypatch):  # noqa: F811
    run_batch(letters("A:90"), given_scores, store, None, clock(0))
    before, version = state_of(store), store._commits.view.version

    def broken(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(SeenStore, "commit", broken)
        with pytest.raises(RuntimeError):
            run_batch(letters("A:10 B:99"), given_scores, store, None, clock(1))
    again = SeenStore(spark, store.root)
    assert state_of(again) == before and again._commits.view.version == version and again.next_batch_id() == 1
    assert len(store._batch_folders("sightings")) == 2
    # Its files go once they are old enough; those of committed batches stay.
    assert store.vacuum(3600) == 0 and store.vacuum(0) == 1
    assert len(store._batch_folders("sightings")) == 1 and state_of(store) == before
    chosen = run_batch(letters("A:10 B:99"), given_scores, store, None, clock(1))
    assert [r.fingerprint for r in chosen.collect()] == ["B"]


def test_a_run_killed_after_its_commit_alerts_when_run_again(letters, store):  # noqa: F811
    def broken(*_):
        raise RuntimeError("killed")

    batch = store.begin()
    with pytest.raises(RuntimeError):
        run_batch(letters("A:90"), given_scores, store, batch, clock(0), sink=broken)
    assert state_of(store)["A"][-1] is False
    again = run_batch(letters("A:90"), given_scores, store, batch.batch_id, clock(0))
    assert [r.fingerprint for r in again.collect()] == ["A"] and state_of(store)["A"][-1] is True


def test_expired_commits_become_one(spark, letters, store, tmp_path):  # noqa: F811
    for n in range(3):
        run_batch(letters(f"A:{n} N{n}:90"), given_scores, store, None, clock(n))
        assert store.batch_id_for("feed", n) == 2 * n + 1
    expected = state_of(store)
    for n in (1, 5):
        store.compact(n)
        store.expire(n)
        assert state_of(store) == expected
    fresh = SeenStore(spark, store.root)
    assert state_of(fresh) == expected and fresh.next_batch_id() == 6 and fresh.batch_id_for("feed", 2) == 5
    numbers = fresh._commits.log.numbers()
    assert numbers[0] > 0 and len(numbers) <= 4
    assert store.vacuum(0) == 0


# ---- filters of merged state --------------------------------------------------------


def test_filters_exclude_no_key_and_most_others(spark):
    keys = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias(KEY))
    others = spark.range(20_000, 40_000).select(F.sha2(F.col("id").cast("string"), 256).alias(KEY))
    blocks = bloom.blocks_for(20_000, 8)
    table = bloom.filters(keys, 8, blocks)
    assert bloom.perhaps_known(keys, table, 8, blocks).count() == 20_000
    assert bloom.perhaps_known(others, table, 8, blocks).count() < 600
    assert table.count() <= 8 * blocks and blocks == 105


def test_buckets_without_a_known_key_are_not_opened(spark, make_posts, tmp_path):
    """The answer is the plain anti-join's; the scan selects the buckets of known keys alone."""
    state = SeenStore(spark, str(tmp_path / "seen"), buckets=32)
    old = make_posts([{"url": f"old{n}", "salary_text": "50"} for n in range(3000)])
    run_batch(old, given_scores, state, None, clock(0))
    state.compact(0)
    rows = spark.createDataFrame([(f"new{n}",) for n in range(500)] + [("old7",), ("old8",)], "fingerprint string")
    new = state.filter_new(rows, 1, rows.count())
    merge = state._merge(state._commits.view, 1)
    expected = not_known(rows, state._base(merge))
    assert sorted(new.collect()) == sorted(expected.collect()) and new.count() == 500

    perhaps = [r.fingerprint for r in state._perhaps_known(rows, merge).collect()]
    assert {"old7", "old8"} <= set(perhaps) and len(perhaps) < 30
    looked_up = state._looked_up(merge, perhaps)
    buckets = {r.b for r in spark.createDataFrame([(k,) for k in perhaps], "k string").select(bloom.bucket_of(F.col("k"), 32).alias("b")).collect()}
    whole = state._base(merge).select(bloom.bucket_of(F.col(KEY), 32).alias("b")).where(F.col("b").isin(buckets)).count()
    # What the scan has read, by its own metrics: rows of these buckets and no others.
    execution = looked_up._jdf.queryExecution()
    execution.toRdd().count()
    (scan,) = [execution.executedPlan().collectLeaves().apply(0)]
    assert 0 < scan.metrics().apply("numOutputRows").value() <= whole < 3000
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        text = state._looked_up(merge, perhaps)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert f"SelectedBucketsCount: {len(buckets)} out of 32" in text


def test_many_known_keys_are_joined(spark, make_posts, tmp_path, monkeypatch):
    monkeypatch.setattr("sift.state.seen.LOOKED_UP_KEYS", 10)
    state = SeenStore(spark, str(tmp_path / "seen"), buckets=4)
    run_batch(make_posts([{"url": f"u{n}", "salary_text": "50"} for n in range(60)]), given_scores, state, None, clock(0))
    state.compact(0)
    rows = spark.createDataFrame([(f"u{n}",) for n in range(40, 80)], "fingerprint string")
    for n_rows in (40, None):
        assert sorted(r.fingerprint for r in state.filter_new(rows, 1, n_rows).collect()) == [f"u{n}" for n in range(60, 80)]


# ---- counts of a run ------------------------------------------------------------------


@pytest.mark.parametrize("on_bad", ["drop_source", "quarantine"])
def test_the_writing_job_counts_the_sources(spark, landing, store, on_bad):  # noqa: F811
    """Without a job of their own: the counts are those that are read from the logs."""
    path = landing(one_a=body("cook", "baker", "cook"), two_a="nope", idle_a="{}")
    names = ["sound", "broken", "idle", "absent"]
    sources = [board_source(lambda s: read_payload_files(s, path), [Board(b)], n) for b, n in zip(("one", "two", "idle"), names)]
    mapped = load_sources(spark, [*sources, board_source(lambda s: read_payload_files(s, path), [Board("one")], "broken")])
    batch = store.begin()
    run_feed(mapped, given_nothing, store, batch, clock(0), on_bad=on_bad, sources=names)
    logged = {r.source: (r.n_posts, r.n_rejects) for r in batch_counts(store, batch.batch_id, names).collect()}
    assert batch.counts == logged and logged["sound"] == (3, 0)
    assert batch.counts["broken"] == ((0 if on_bad == "drop_source" else 3), 1)
    assert count_lines(batch.counts)[0] == "absent: 0 posts" and len(count_lines(batch.counts)) == 4


def given_nothing(posts):
    return keyword_scorer(RuleSet())(posts)
