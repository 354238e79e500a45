"""The seen state as keyed state of a stream: what the logs hold after the same files."""

from __future__ import annotations

import json

from test_runs import BOARDS, RULES, body, clock, landing, store  # noqa: F401

from sift.plans.batch import keyword_scorer, run_feed
from sift.sources.collect import QUARANTINE, board_source
from sift.sources.payloads import read_payload_files
from sift.streaming.keyed import newest, seen_changes

COLUMNS = ["fingerprint", "score", "source", "company", "title", "url"]


def take(spark, path, tmp_path, seen):
    """Everything that has landed since, as one micro-batch; started anew from the checkpoint."""
    def keep(changes, _):
        seen.append([r.asDict() for r in changes.collect()])

    stream = seen_changes(spark, path, BOARDS, keyword_scorer(RULES)).writeStream.foreachBatch(keep).outputMode("update")
    stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()


def test_keyed_state_is_the_logs_state_restart_included(spark, landing, store, tmp_path):  # noqa: F811
    seen = []
    files = [
        {"one_a": body("Data Analyst sql", "cook", "Data Analyst sql"), "two_a": body("intern", "Data Analyst sql")},
        {"one_b": body("cook", "Data Analyst lead python", "baker"), "two_b": "nope"},
        {"one_c": json.dumps({"jobs": [{"title": "cook", "absolute_url": "u/cook", "content": {"description": "sql dbt"}}, {"title": 5}]})},
    ]
    for n, landed in enumerate(files):
        path = landing(**landed)
        take(spark, path, tmp_path, seen)
        own = [f"board={k.partition('_')[0]}/{k.partition('_')[2]}.json" for k in landed]
        rows = read_payload_files(spark, path)
        rows = rows.where(rows.landed.rlike("|".join(own)))
        run_feed(board_source(lambda _, r=rows: r, BOARDS).load(spark, 0), keyword_scorer(RULES), store, n, clock(n), on_bad=QUARANTINE)
        state = spark.createDataFrame([r for batch in seen for r in batch])
        assert sorted(map(tuple, newest(state).select(COLUMNS).collect())) == sorted(map(tuple, store.state().select(COLUMNS).collect())), n
    # Each batch touched its own keys; a key is new once, and keeps when that was.
    assert [sorted(r["title"] for r in batch if r["is_new"]) for batch in seen] == [["Data Analyst sql", "Data Analyst sql", "cook", "intern"], ["Data Analyst lead python", "baker"], []]
    (cook,) = [r for r in seen[2] if r["title"] == "cook"]
    (first,) = [r for r in seen[0] if r["title"] == "cook"]
    assert len(seen[2]) == 1 and cook["first_seen"] == first["first_seen"] < cook["last_seen"] and cook["score"] > first["score"]
