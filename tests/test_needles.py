"""Needles in one pass: exactly the substrings that a plain search finds, in list order."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sift.functions import needles
from sift.functions.text import UNROLL_LIMIT, contains_any, first_contained
from sift.operators.scoring import capped_bump


def lists(rng, alphabet, n):
    return ["".join(rng.choices(alphabet, k=rng.randrange(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("alphabet", ["ab", "abc de", ".*+?()[]{}|^$\\-&#", "aé中😀́\n\"'", "abcdefghijklmnopqrstuvwxyz0123456789"])
def test_every_substring_is_found(spark, alphabet):
    rng = random.Random(alphabet)
    texts = ["", *("".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(200))]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "n int, t string")
    for size in (1, 13, 60):
        own = lists(rng, alphabet, size) + ["".join(rng.choices(alphabet, k=30))]
        t = F.col("t")
        found = rows.select("n", needles.positions(t, own).alias("p"), F.rlike(t, F.lit(needles.any_of(own))).alias("any"), first_contained(t, own).alias("first"), contains_any(t, own).alias("some"))
        for r in found.collect():
            if r.n == len(texts):
                assert r.p is r.first is None
                continue
            expected = [k for k, needle in enumerate(own) if needle in texts[r.n]]
            assert r.p == expected and r["any"] == r.some == bool(expected)
            assert r.first == (own[expected[0]] if expected else None)


def test_patterns_share_beginnings_and_halve_choices():
    assert needles.any_of(["data", "data quality", "dbt"]) == r"d(?:ata(?:\x{20}quality)?|bt)"
    many = needles.any_of([f"{c}x" for c in "abcdefgh"])
    assert many.count("(?=[") == 3 and re.fullmatch(many, "cx") and not re.fullmatch(many, "xc")
    # Long needles and long lists compile: nothing nests deeper than needles branch.
    assert len(needles.any_of(["a" * 5000, "a" * 4999 + "b"])) < 5100


def test_repeated_and_nested_skills_count_as_listed(spark):
    skills = ["sql", "postgresql", "sql", "post", *(f"absent{n}" for n in range(UNROLL_LIMIT)), "q"]
    rows = spark.createDataFrame([("postgresql",), ("none",)], "t string")
    assert [r[0] for r in rows.select(capped_bump(F.col("t"), skills)).collect()] == [
        capped for capped in ("sql:+3\x1fpostgresql:+3\x1fsql:+3\x1fpost:+3".replace("\x1f", _separator()), "")
    ]


def _separator():
    from sift.params import REASON_SEPARATOR

    return REASON_SEPARATOR


def test_long_lists_stay_out_of_lambdas_over_needles(spark):
    own = [f"word {n}" for n in range(400)]
    plan = spark.range(1).select(contains_any(F.col("id").cast("string"), own))._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan.upper() and "exists(" not in plan
