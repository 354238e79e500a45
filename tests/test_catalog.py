"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from sift.catalog import oracles, queries, views
from sift.operators import dedup, scoring
from tools.compare import compare, connect

# Other parts of the library test their own queries.
NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def con():
    from conftest import TESTDATA

    return connect(f"{TESTDATA}/sf0.001")


def test_every_query_has_a_counterpart():
    assert set(NAMES) == set(oracles.oracle_sql())
    assert set(NAMES) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, sf_small, name):
    outcome = compare(spark, con, name, sf_small)
    assert outcome.startswith("ok"), outcome


def test_entry_runs(spark):
    assert spark_entry.entry(spark).columns[0] == "route"


@pytest.mark.parametrize("name", NAMES)
def test_no_query_leaves_the_jvm(spark, sf_small, name):
    plan = spark_entry.queries()[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "NestedLoopJoin"):
        assert node not in plan


def test_only_first_and_last_lines_of_a_part_are_scored(spark, sf_small, tmp_path):
    """Ties, nulls, repeated parts and parts of one line: as from all lines, but from two rows a part at most."""
    lines = spark.read.parquet(f"{sf_small}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    odd = [(None, 1, 1, 1, 1.0, "R", "F"), (5, None, 1, 1, 1.0, None, "O"), (-5, 3, 2, None, None, "A", None), (-5, 3, 2, 7, None, "N", "O"),
           (7, 1, None, 1, 1.0, "R", "F"), (7, 1, 999_999, 1, 1.0, "R", "F"), (7, 1, 500_000, 1, 1.0, "N", "O")]
    lines.unionByName(spark.createDataFrame(odd, lines.schema)).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_small}/part.parquet")
    more = parts.where("p_partkey = 1").unionByName(parts.where("p_partkey = 2").withColumn("p_partkey", F.lit(500_000).cast("bigint")))
    parts.unionByName(more).write.parquet(f"{tmp_path}/part.parquet")
    every = dedup.batch_summary(queries._scored_offers(spark, str(tmp_path)), queries.ALERT_FIELDS).drop("n_rows")
    few = scoring.score(views.offer_ends(spark, str(tmp_path), last=True), views.OFFER_RULES)
    found = dedup.batch_summary(few, queries.ALERT_FIELDS).drop("n_rows")
    assert sorted(map(str, found.collect())) == sorted(map(str, every.collect()))
    new = queries._new_offers(spark, str(tmp_path))
    expected = every.withColumnRenamed("first_score", "score").select(*new.columns)
    assert sorted(map(str, new.collect())) == sorted(map(str, expected.collect()))
    assert views.offer_ends(spark, str(tmp_path)).count() == parts.join(spark.read.parquet(f"{tmp_path}/lineitem.parquet"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").count() + 2


def test_lines_are_combined_before_they_are_joined(spark, sf_small):
    """The aggregation by part stands below the join in every query on first offers."""
    names = ("dedup_first", "digest_cap", "notified_set", "route_instant", "route_digest", "run_once", "alerts", "format_alert", "seen_top20")
    for name in names:
        plan = queries.queries()[name](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Join Inner") :]
        assert "Aggregate [l_partkey" in below, name
