from __future__ import annotations

import json
import pathlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sift.catalog import queries as spark_queries
from sift.catalog import views
from sift.operators import dedup
from sift.operators.routing import alert_lines, alerted, in_printing_order
from sift.params import Board, RuleSet, Thresholds
from sift.plans import replay
from sift.plans.batch import batch_counts, keyword_scorer, run_batch, run_feed, text_sink
from sift.sources.collect import DROP_SOURCE, QUARANTINE, board_source, isolate_sources
from sift.sources.payloads import read_payload_files, read_payload_lines
from sift.operators import mapping
from sift.state.seen import SeenStore
from sift.streaming.feed import start_feed

RULES = RuleSet(roles=("data analyst",), skills=("dbt",), exclude=("intern",))


def clock(n):
    return datetime(2024, 1, n + 1, tzinfo=timezone.utc)


def given_scores(posts):
    """A scorer that takes the score and fingerprint from the posting itself."""
    return posts.withColumns({
        "fingerprint": F.col("url"), "score": F.col("salary_text").cast("int"),
        "reasons": F.array().cast("array<string>"),
    })


def text_of(path):
    """Alert files in printing order, as one text."""
    parts = sorted(pathlib.Path(path).glob("section=*/part-*"))
    return "".join(p.read_text() for p in parts)


@pytest.fixture
def store(spark, tmp_path):
    return SeenStore(spark, str(tmp_path / "seen"), buckets=4)


@pytest.fixture
def letters(make_posts):
    def make(text):
        rows = []
        for n, word in enumerate(text.split()):
            letter, points = word.split(":")
            rows.append({"url": letter, "title": f"{letter}{n}", "salary_text": points})
        return make_posts(rows)

    return make


def state_of(store, before=None):
    rows = store.state(before).collect()
    return {
        r.fingerprint: (r.score, r.title, r.first_seen.day, r.last_seen.day, r.notified) for r in rows
    }


# Input, digest cap, alerted, heading of an empty digest, state after.
GOLDEN = [
    ("A:90 B:70 A:40", 15, {"A", "B"}, {"A": (40, "A0", 2, 2, True), "B": (70, "B1", 2, 2, True)}),
    ("A:95 C:72", 15, {"C"}, {"A": (95, "A0", 2, 3, True), "C": (72, "C1", 3, 3, True)}),
    ("D:70 E:84 F:71", 1, {"D"}, {"D": (70, "D0", 4, 4, True), "E": (84, "E1", 4, 4, False),
                                 "F": (71, "F2", 4, 4, False)}),
    ("E:99 F:99", 15, set(), {"E": (99, "E1", 4, 5, False), "F": (99, "F2", 4, 5, False)}),
    ("G:70", 0, set(), {"G": (70, "G0", 6, 6, False)}),
    ("", 15, set(), {}),
    ("H:0", 15, set(), {"H": (0, "H0", 8, 8, False)}),
]


def run_golden(letters, store, n, tmp_path):
    words, cap, _, _ = GOLDEN[n - 1]
    limits = Thresholds(digest_max_items=cap)
    sink = text_sink(str(tmp_path / "alerts"), limits)
    return run_batch(letters(words), given_scores, store, n, clock(n), limits, sink)


def test_golden_store_vectors_replay_and_compaction(spark, letters, store, tmp_path):
    expected = {}
    for n, (_, _, chosen, after) in enumerate(GOLDEN, start=1):
        alerted_now = run_golden(letters, store, n, tmp_path)
        assert {r.fingerprint for r in alerted_now.collect()} == chosen, n
        expected.update(after)
        assert state_of(store) == expected, n
        if n == 4:
            store.compact(2)

    # A digest whose cap is zero still has its heading, and nothing else.
    assert text_of(tmp_path / "alerts" / "batch_id=5") == "\n=== DIGEST (medium match) ===\n"
    assert text_of(tmp_path / "alerts" / "batch_id=6") == ""

    # Running any batch again changes neither the state nor its alerts.
    for n in (1, 2, 4):
        before = text_of(tmp_path / "alerts" / f"batch_id={n}")
        again = run_golden(letters, store, n, tmp_path)
        assert {r.fingerprint for r in again.collect()} == GOLDEN[n - 1][2], n
        assert text_of(tmp_path / "alerts" / f"batch_id={n}") == before, n
    assert state_of(store) == expected

    assert dedup.duplicate_keys(store.state()).count() == 0
    # The same folder opened anew, in a catalog that does not know the table.
    spark.sql(f"DROP TABLE {store._table(2)}")
    assert state_of(SeenStore(spark, store.root, buckets=4)) == expected


def test_batch_ids_are_kept_apart(letters, store):
    assert store.next_batch_id() == 0
    assert [store.batch_id_for("x", 0), store.batch_id_for("x", 1)] == [0, 1]
    run_batch(letters("A:1"), given_scores, store, store.next_batch_id(), clock(0))
    assert store.batch_id_for("x", 2) == 3
    assert store.batch_id_for("y", 0) == 4
    assert [store.batch_id_for("x", n) for n in (0, 1, 2)] == [0, 1, 3]


def test_compaction_can_be_repeated(spark, letters, store, tmp_path):
    expected = {}
    for n in (1, 2):
        run_golden(letters, store, n, tmp_path)
        expected.update(GOLDEN[n - 1][3])
        store.compact(n)
        store.compact(n)
        assert state_of(store) == expected
    # A run that brings nothing, and merges again.
    run_golden(letters, store, 6, tmp_path)
    for _ in range(2):
        store.compact(6)
    store.expire(6)
    assert state_of(store) == expected
    assert store._batch_folders("sightings") == [] and not (tmp_path / "seen" / "base_2").exists()
    assert state_of(SeenStore(spark, store.root, buckets=4)) == expected


def test_a_path_with_a_quote(spark, letters, tmp_path):
    store = SeenStore(spark, str(tmp_path / "it's"), buckets=2)
    run_golden(letters, store, 1, tmp_path)
    store.compact(1)
    spark.sql(f"DROP TABLE {store._table(1)}")
    assert state_of(store) == GOLDEN[0][3]


def test_state_before_a_batch(letters, store, tmp_path):
    for n in (1, 2):
        run_golden(letters, store, n, tmp_path)
    assert state_of(store, 2) == GOLDEN[0][3]
    assert state_of(store, 1) == {}


def test_marks_of_unknown_fingerprints_do_not_count(spark, letters, store, tmp_path):
    run_golden(letters, store, 1, tmp_path)
    early = spark.createDataFrame([("C",), ("nobody",)], "fingerprint string")
    store.mark_notified(early.unionByName(store._of("routed", 1).select("fingerprint")), 1)
    run_batch(letters("C:60"), given_scores, store, 2, clock(2))
    state = state_of(store)
    assert state["C"][-1] is False and state["A"][-1] is True and "nobody" not in state


def test_the_state_is_not_moved_after_compaction(spark, letters, store, tmp_path):
    run_golden(letters, store, 1, tmp_path)
    store.compact(1)
    rows = letters("A:90 Z:90").select(F.col("url").alias("fingerprint"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = store.filter_new(rows, 2)
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert [r.fingerprint for r in large.collect()] == ["Z"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange for the rows and one for the recent log, none for the table.
    assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan
    assert "ReadSchema: struct<fingerprint:string>" in plan
    small = store.filter_new(rows, 2, 2)
    assert [r.fingerprint for r in small.collect()] == ["Z"]
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_alerts_read_like_the_printed_report(make_posts, store, tmp_path):
    posts = make_posts([
        {"title": "Data Analyst", "description": "sql", "url": "u0"},
        {"title": "Data Analyst", "url": "u1", "location": "", "remote": False},
        {"title": "Data Analyst", "url": "u2", "remote": True, "description": "sql"},
        {"title": "sql", "url": "u3"},
        {"title": "cook", "url": "u4"},
    ])
    limits = Thresholds()
    sink = text_sink(str(tmp_path / "alerts"), limits)
    run_batch(posts, keyword_scorer(RULES), store, 0, clock(0), limits, sink)
    assert text_of(tmp_path / "alerts" / "batch_id=0") == (
        "\n=== INSTANT (high match) ===\n"
        "[ 90] Data Analyst\n      acme — Rome — onsite/unknown\n      u0\n"
        "      reasons: role_match:+20, sql:+20\n\n"
        "[100] Data Analyst\n      acme — Rome — remote\n      u2\n"
        "      reasons: role_match:+20, sql:+20, remote:+15\n\n"
        "\n=== DIGEST (medium match) ===\n"
        "[ 70] Data Analyst\n      acme — N/A — onsite/unknown\n      u1\n"
        "      reasons: role_match:+20\n\n"
        "[ 70] sql\n      acme — Rome — onsite/unknown\n      u3\n"
        "      reasons: sql:+20\n\n"
    )


def test_no_reasons_and_crossed_thresholds(make_posts):
    crossed = Thresholds(instant=40, digest=60)
    rows = keyword_scorer(RULES)(make_posts([{"url": "u"}])).withColumn("route", F.lit("instant"))
    text = alert_lines(rows, crossed).where("is_alert = 1").first().text
    assert text == "[ 50] Analyst\n      acme — Rome — onsite/unknown\n      u\n      reasons: -\n"
    with pytest.raises(ValueError):
        Thresholds(digest_max_items=-1)


def test_replay_agrees_with_batch_after_batch(spark, sf_small, store):
    events = views.event_sightings(spark, sf_small).withColumns({
        "batch_id": F.floor(F.col("batch_id") / 8), "now": F.lit(None).cast("timestamp"),
    })
    limits = Thresholds(instant=90, digest=20, digest_max_items=3)
    batches = sorted(r.batch_id for r in events.select("batch_id").distinct().collect())
    stamps = F.create_map(*[F.lit(x) for n, b in enumerate(batches) for x in (b, clock(n))])
    events = events.withColumn("now", stamps[F.col("batch_id")])
    keep = ("source", "company", "title", "url")
    whole = replay.replay_state(events, limits, keep)

    absent = F.lit(None).cast("string")
    seq = F.struct(
        F.lit(0).alias("source_ord"), F.lit(0).alias("board_ord"), F.lit("").alias("landed"),
        F.col("ingest_seq").alias("landed_pos"), F.lit(0).alias("pos"),
    )
    rows = events.withColumns({
        "ingest_seq": seq, "location": absent, "remote": F.lit(None).cast("boolean"),
        "reasons": F.array().cast("array<string>"),
    })
    for n, b in enumerate(batches):
        run_batch(rows.where(F.col("batch_id") == b), lambda d: d, store, b, clock(n), limits)
    columns = ["fingerprint", "first_seen", "last_seen", "score", *keep, "notified"]
    stepwise = {tuple(r) for r in store.state().select(columns).collect()}
    assert {tuple(r) for r in whole.select(columns).collect()} == stepwise
    assert any(r[-1] for r in stepwise) and not all(r[-1] for r in stepwise)


def test_order_does_not_depend_on_partitions(spark, sf_small):
    offers = views.offers(spark, sf_small)
    results = []
    for rows in (offers, offers.repartition(7, F.rand(1))):
        new = dedup.batch_summary(keyword_scorer(views.OFFER_RULES)(rows), ("title", "reasons"))
        results.append(sorted(str(r) for r in new.collect()))
    assert results[0] == results[1]


def test_hot_keys_are_combined_before_the_shuffle(spark):
    """One fingerprint with most rows sends one row per map task."""
    rows = spark.range(0, 20000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("fingerprint"),
        F.col("id").alias("ingest_seq"), F.lit(50).alias("score"), F.lit("t").alias("title"),
    )
    summary = dedup.batch_summary(rows, ("title",))
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and plan.count("Exchange hashpartitioning") == 1
    hot = summary.where("fingerprint = 'hot'").first()
    assert (hot.ingest_seq, hot.n_rows) == (1, 13333)


# ---- feeds --------------------------------------------------------------------

BOARDS = (Board("one", "First"), Board("two"), Board("idle"))


def body(*titles):
    return json.dumps({"jobs": [{"title": t, "absolute_url": f"u/{t}"} for t in titles]})


@pytest.fixture
def landing(tmp_path):
    def land(**bodies):
        for name, text in bodies.items():
            board, _, file = name.partition("_")
            folder = tmp_path / "landing" / f"board={board}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{file}.json").write_text(text)
        return str(tmp_path / "landing")

    return land


def feed(spark, path, boards=BOARDS):
    return board_source(lambda s: read_payload_files(s, path), boards).load(spark, 0)


def test_stream_and_batch_agree(spark, landing, store, tmp_path):
    path = landing(
        one_a=body("Data Analyst sql", "cook"),
        two_a=body("Data Analyst", "intern", "Data Analyst"),
        three_a=body("Data Analyst of a board that is not configured"),
    )
    scorer, limits = keyword_scorer(RULES), Thresholds()
    sink = text_sink(str(tmp_path / "alerts"), limits)
    options = {"checkpoint": str(tmp_path / "cp"), "clock": clock, "sink": sink}
    start_feed(spark, path, BOARDS, scorer, store, limits, **options).awaitTermination()

    other = SeenStore(spark, str(tmp_path / "other"))
    run_feed(feed(spark, path), scorer, other, 0, clock(0), limits)
    assert sorted(store.state().collect()) == sorted(other.state().collect())
    assert other.state().count() == 4

    # What lands later is the next batch; what was seen is not alerted again.
    landing(one_b=body("Data Analyst sql", "sql data analyst lead python"))
    start_feed(spark, path, BOARDS, scorer, store, limits, **options).awaitTermination()
    assert "lead python" in text_of(tmp_path / "alerts" / "batch_id=1")
    assert "Data Analyst sql" not in text_of(tmp_path / "alerts" / "batch_id=1")
    counts = {r.source: r.n_posts for r in batch_counts(store, 1).collect()}
    assert counts == {"greenhouse": 2}


@pytest.mark.parametrize("on_bad", [DROP_SOURCE, QUARANTINE])
def test_many_files_are_one_run_on_both_paths(spark, landing, tmp_path, on_bad):
    """More files than a batch used to take, a bad body among them, and a cap of one."""
    bodies = {f"one_{n:04}": body(f"Data Analyst {n}") for n in range(8)} | {"two_0": "nope"}
    path, limits = landing(**bodies), Thresholds(85, 70, 1)
    scorer = keyword_scorer(RULES)
    first, second = (SeenStore(spark, str(tmp_path / name)) for name in ("first", "second"))
    sink = text_sink(str(tmp_path / "alerts"), limits)
    options = {"checkpoint": str(tmp_path / "cp"), "clock": clock, "sink": sink, "on_bad": on_bad}
    start_feed(spark, path, BOARDS, scorer, first, limits, **options).awaitTermination()
    by_hand = text_sink(str(tmp_path / "by_hand"), limits)
    run_feed(feed(spark, path), scorer, second, 0, clock(0), limits, by_hand, on_bad)
    assert sorted(first.state().collect()) == sorted(second.state().collect())
    n_kept = 8 if on_bad == QUARANTINE else 0
    assert first.state().count() == n_kept
    alerts = text_of(tmp_path / "alerts" / "batch_id=0")
    assert alerts == text_of(tmp_path / "by_hand" / "batch_id=0") and alerts.count("[ 70]") == min(1, n_kept)
    # What failed has left a trace and a line in the counts.
    (reject,) = first.rejects_of(0).collect()
    assert (reject.source, reject.reject, reject.n_rows) == ("greenhouse", "body is not valid JSON", 1)
    lines = [r.message for r in batch_counts(first, 0, ["greenhouse", "idle"]).orderBy("source").collect()]
    assert lines == [f"greenhouse: {n_kept} posts, 1 rejects", "idle: 0 posts"]
    # The number of a batch that was dropped whole is not given out again.
    assert first.next_batch_id() == second.next_batch_id() == 1


def test_folders_of_other_boards_are_pruned(spark, landing):
    path = landing(one_a=body("Data Analyst"), other_a=body("Data Analyst"))
    read = read_payload_files(spark, path, BOARDS)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [board" in plan
    assert [r.token for r in read.collect()] == ["one"]


def test_bodies_as_lines(spark, landing):
    path = landing(one_a="\n".join([body("Data Analyst"), "", body("cook", "baker"), "nope"]))
    rows = read_payload_lines(spark, path, BOARDS).orderBy("landed_pos").collect()
    assert [r.payload for r in rows] == [body("Data Analyst"), body("cook", "baker"), "nope"]
    mapped = board_source(lambda s: read_payload_lines(s, path), BOARDS).load(spark, 0)
    assert [r.reject for r in mapped.orderBy("ingest_seq").collect()] == [None, None, None, "body is not valid JSON"]


@pytest.mark.parametrize("threshold", ["1024"])
def test_no_feed_is_shuffled_by_its_source_or_batch(spark, sf_small, landing, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plans = [
            spark_queries.queries()[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
            for name in ("source_isolation", "run_replay")
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [source" not in plans[0] and "SortMergeJoin [first_batch" not in plans[1]
    assert all("BroadcastHashJoin" in plan for plan in plans)


def test_a_reject_drops_its_source_only(spark, landing, store):
    bad = json.dumps({"jobs": [{"title": "Data Analyst", "absolute_url": "u"}, {"title": 5}]})
    path = landing(one_a=body("Data Analyst"), two_a=bad)
    pages = lambda s: read_payload_files(s, path)
    mapped = board_source(pages, BOARDS[:1], "sound").load(spark, 0)
    mapped = mapped.unionByName(board_source(pages, BOARDS[1:], "broken").load(spark, 1))
    run_feed(mapped, keyword_scorer(RULES), store, 0, clock(0))
    assert {r.source for r in store.state().collect()} == {"sound"}
    lazily = isolate_sources(mapped)
    assert [r.source for r in lazily.collect()] == ["sound"]
    run_feed(mapped, keyword_scorer(RULES), store, 0, clock(0), on_bad=QUARANTINE)
    assert {r.source for r in store.state().collect()} == {"sound", "broken"}
    assert mapping.rejects(mapped).count() == 1


def test_nothing_landed(spark, landing, store, tmp_path):
    path = landing(one_a="{}")
    sink = text_sink(str(tmp_path / "alerts"), Thresholds())
    chosen = run_feed(feed(spark, path), keyword_scorer(RULES), store, 0, clock(0), sink=sink)
    assert chosen.count() == 0 and store.state().count() == 0
    assert text_of(tmp_path / "alerts" / "batch_id=0") == ""


def test_printing_order_spreads_over_partitions(spark):
    rows = spark.range(0, 4000, 1, 4).select(
        F.lit("instant").alias("route"), F.col("id").cast("string").alias("fingerprint"),
        F.lit(90).alias("score"), F.lit("t").alias("title"), F.lit("c").alias("company"),
        F.lit("l").alias("location"), F.lit("u").alias("url"), F.lit(True).alias("remote"),
        F.array().cast("array<string>").alias("reasons"), (-F.col("id")).alias("ingest_seq"),
    )
    limits = Thresholds()
    assert alerted(rows, limits).count() == 4000
    ordered = in_printing_order(alert_lines(rows, limits))
    assert "rangepartitioning" in ordered._jdf.queryExecution().executedPlan().toString()
    keys = [r.ingest_seq for r in ordered.collect()]
    assert keys == [None, *range(-3999, 1)]
