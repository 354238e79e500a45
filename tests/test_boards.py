"""Boards kept as a table: their join prunes landed folders when the query runs."""

from __future__ import annotations

import json

import pytest
from test_runs import RULES, clock, store  # noqa: F401

from sift.params import Board
from sift.plans.batch import keyword_scorer, run_feed
from sift.sources.boards import boards_table, join_boards
from sift.sources.collect import board_source
from sift.sources.payloads import read_payload_files


@pytest.fixture
def landing(tmp_path):
    for n in range(40):
        folder = tmp_path / "landing" / f"board=b{n}"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(json.dumps({"jobs": [{"title": f"Data Analyst {n}", "absolute_url": f"u{n}"}]}))
    return str(tmp_path / "landing")


@pytest.fixture
def table(spark, tmp_path):
    rows = [("b3", "Third", 1), ("b7", None, 0), ("b3", "Third again", 2), ("b9", "left out", None), ("b8", "switched off", -1), ("idle", None, 3)]
    spark.createDataFrame(rows, "token string, company string, board_ord int").write.parquet(str(tmp_path / "boards"))
    return spark.read.parquet(str(tmp_path / "boards"))


def test_folders_are_pruned_when_the_query_runs(spark, landing, table):
    joined = join_boards(read_payload_files(spark, landing), boards_table(table))
    assert sorted((r.token, r.company, r.board_ord) for r in joined.collect()) == [("b3", "Third", 1), ("b3", "Third again", 2), ("b7", "b7", 0)]
    execution = joined._jdf.queryExecution()
    execution.toRdd().count()
    plan = execution.executedPlan().toString()
    assert "dynamicpruning" in plan and "b7" not in plan
    # Two of forty folders are read.
    scans = [n for n in _nodes(execution.executedPlan()) if n.nodeName().strip().startswith("Scan text")]
    assert {n.metrics().apply("numFiles").value() for n in scans} == {2}


def _nodes(plan):
    """All nodes of a plan, through the adaptive one and its stages."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else []
    children = plan.children()
    found = [plan]
    for child in inner + [children.apply(k) for k in range(children.size())]:
        found += _nodes(child)
    return found


def test_a_feed_of_a_table_is_that_of_a_list(spark, landing, table, store):  # noqa: F811
    boards = [Board("b7"), Board("b3", "Third"), Board("b3", "Third again"), Board("idle")]
    listed = board_source(lambda s: read_payload_files(s, landing, boards), boards).load(spark, 0)
    tabled = board_source(lambda s: read_payload_files(s, landing), table).load(spark, 0)
    columns = ["title", "company", "url"]
    assert sorted(tabled.select(columns).collect()) == sorted(listed.select(columns).collect())
    chosen = run_feed(tabled, keyword_scorer(RULES), store, None, clock(0))
    assert sorted((r.title, r.company) for r in chosen.collect()) == [("Data Analyst 3", "Third"), ("Data Analyst 3", "Third again"), ("Data Analyst 7", "b7")]


def test_a_long_table_is_left_to_the_optimizer(spark, table, monkeypatch):
    monkeypatch.setattr("sift.sources.boards.MAX_BROADCAST_BOARDS", 2)
    assert "ResolvedHint" not in boards_table(table)._jdf.queryExecution().analyzed().toString()
