from __future__ import annotations

import hashlib
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.functions.text import UNROLL_LIMIT, fingerprint
from sift.operators.scoring import score
from sift.params import RuleSet

RULES = {
    "roles": ("data analyst", "analytics engineer", "product analyst"),
    "skills": ("sql", "python", "postgres", "dbt", "data quality"),
    "exclude": ("intern", "stage", "tirocinio", "call center", "promoter"),
}
FIVE = ("dbt", "spark", "airflow", "kafka", "flink")

# name, rule changes, posting, score, reasons
GOLDEN = [
    ("G1", {}, {"title": "Data Analyst", "description": "SQL and Python"}, 100,
     ["role_match:+20", "sql:+20", "python:+10"]),
    ("G2", {}, {"title": "Data Analyst Intern"}, 0, ["kill:intern"]),
    ("G3", {}, {"title": "Internal Tools Analyst"}, 0, ["kill:intern"]),
    ("G4", {}, {"title": "Backend Engineer", "description": "PostgreSQL, dbt"}, 76,
     ["sql:+20", "postgres:+3", "dbt:+3"]),
    ("G5", {}, {"title": "Staff Data Analyst", "remote": True}, 60,
     ["role_match:+20", "remote:+15", "senior_penalty:-25"]),
    ("G6", {}, {"title": "Analyst"}, 50, []),
    ("G7", {}, {"title": "Leading Product Analyst"}, 45,
     ["role_match:+20", "senior_penalty:-25"]),
    ("G8", {}, {"title": "Data Analyst", "description": "distributed SQL", "remote": True}, 100,
     ["role_match:+20", "sql:+20", "remote:+15"]),
    ("G9", {"skills": FIVE}, {"title": "Engineer", "description": " ".join(FIVE)}, 62,
     ["dbt:+3", "spark:+3", "airflow:+3", "kafka:+3"]),
    ("G10", {"skills": ("dbt", "dbt")}, {"title": "Engineer", "description": "dbt"}, 56,
     ["dbt:+3", "dbt:+3"]),
    ("G11", {"weights": {"senior_penalty": 80}}, {"title": "VP"}, 0, ["senior_penalty:-80"]),
    ("G12", {"weights": {"skill_sql": 7.9}}, {"title": "SQL"}, 57, ["sql:+7"]),
    ("G13", {"exclude": ("stage", "intern")}, {"title": "intern stage"}, 0, ["kill:stage"]),
    ("G14", {"exclude": ("  INTERN ",)}, {"title": "intern"}, 0, ["kill:intern"]),
    ("G15", {"exclude": ("", None)}, {"title": "Analyst"}, 50, []),
    ("G16", {}, {"title": "Analyst", "remote": False}, 50, []),
    ("G17", {"skills": ()}, {"title": "Tester", "description": "python"}, 60, ["python:+10"]),
    ("negative", {"weights": {"skill_sql": -5, "senior_penalty": -5}}, {"title": "SQL lead"}, 50,
     ["sql:+-5", "senior_penalty:--5"]),
    ("null fields", {}, {"title": "x", "location": None, "description": None, "tags": None,
                         "salary_text": "testing"}, 60, ["data_quality:+10"]),
    ("lines", {"exclude": ("a\nb",)}, {"title": "a", "company": "b"}, 0, ["kill:a\nb"]),
    ("tags", {"exclude": ("x y",)}, {"tags": ["x", "y"]}, 0, ["kill:x y"]),
]


def test_golden_vectors(make_posts):
    parts = []
    for name, change, post, _, _ in GOLDEN:
        scored = score(make_posts([post]), RuleSet(**{**RULES, **change}))
        parts.append(scored.select(F.lit(name).alias("name"), "score", "reasons"))
    got = {r.name: (r.score, r.reasons) for r in reduce(DataFrame.unionAll, parts).collect()}
    assert got == {name: (points, why) for name, _, _, points, why in GOLDEN}


def test_long_lists_give_the_same_result(make_posts):
    filler = tuple(f"absent{i}" for i in range(UNROLL_LIMIT))
    posts = make_posts([
        {"title": "Data Analyst dbt airflow", "description": "postgres kafka spark flink"},
        {"title": "intern stage"},
        {"title": "nothing"},
    ])
    base = {"roles": ("data analyst",), "skills": (*FIVE, "postgres"), "exclude": ("stage", "intern")}
    short = score(posts, RuleSet(**base))
    long = score(posts, RuleSet(**{k: filler + v for k, v in base.items()}))
    picked = ["fingerprint", "score", "reasons"]
    assert sorted(short.select(picked).collect()) == sorted(long.select(picked).collect())


@pytest.mark.parametrize(
    "key,expected",
    [
        (("greenhouse", "stripe", "https://example.test/jobs/1"), "8cf7a37d807ebcbf"),
        (("Greenhouse", "Stripe", "HTTPS://example.test/Jobs/1 "), "8cf7a37d807ebcbf"),
        (("greenhouse", "é", "https://example.test/ü"), "b44de1b337ecf7e9"),
    ],
)
def test_fingerprint(spark, key, expected):
    row = spark.range(1).select(fingerprint(*[F.lit(k) for k in key]).alias("f")).first()
    assert row.f == expected
    assert row.f == hashlib.sha256("|".join(key).strip().lower().encode()).hexdigest()[:16]


def test_score_properties(spark, sf_small):
    from sift.catalog import views

    rows = score(views.offers(spark, sf_small), views.OFFER_RULES)
    killed = F.exists("reasons", lambda r: r.startswith("kill:"))
    broken = rows.where(
        ~F.col("score").between(0, 100)
        | (F.size("reasons") > 10)
        | (killed & ((F.size("reasons") != 1) | (F.col("score") != 0)))
    )
    assert broken.count() == 0


def test_bad_parameters_fail_early():
    with pytest.raises(ValueError):
        RuleSet(weights={"remote": "many"})
    with pytest.raises(TypeError):
        RuleSet(roles="data analyst")
    with pytest.raises(ValueError):
        RuleSet(skills=("a\u001fb",))


def test_scoring_is_one_stage_without_python(make_posts):
    plan = score(make_posts([{}]), RuleSet(**RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
