"""Ordered keyword rules over one searchable text per posting.

Scoring is a chain of narrow projections: the lower-cased text is built once,
each rule becomes one column over it, and the last projection adds them up. No
shuffle, no Python, and the raw text is dropped before anything moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.functions.needles import listed, positions
from sift.functions.text import (
    UNROLL_LIMIT,
    blank_if_null,
    contains_any,
    fingerprint,
    first_contained,
)
from sift.params import (
    BASE_SCORE,
    GENERIC_MAX_HITS,
    GENERIC_POINTS,
    MAX_REASONS,
    MAX_SCORE,
    MIN_SCORE,
    REASON_SEPARATOR,
    RuleSet,
)

TEXT = "_text"


def search_text() -> Column:
    """Eight fields on eight lines, lower-cased; an empty field keeps its line.

    Outer blanks need no trim: needles never start or end with one.
    """
    before = ("title", "company", "location", "description")
    after = ("seniority", "contract_type", "salary_text")
    tags = blank_if_null(F.array_join(F.col("tags"), " "))
    fields = [blank_if_null(F.col(c)) for c in before]
    fields += [tags, *[blank_if_null(F.col(c)) for c in after]]
    return F.lower(F.concat_ws("\n", *fields))


def kill_keyword(text: Column, rules: RuleSet) -> Column:
    """The first excluded keyword in rule order that occurs, or NULL."""
    return first_contained(text, rules.exclude)


def role_match(text: Column, rules: RuleSet) -> Column:
    return contains_any(text, rules.roles)


def senior_penalty(text: Column, rules: RuleSet) -> Column:
    return contains_any(text, rules.senior_markers)


def remote_boost() -> Column:
    return F.col("remote").eqNullSafe(F.lit(True))


def capped_bump(text: Column, skills: Sequence[str]) -> Column:
    """Reasons of the first few generic skills that occur, as one joined string."""
    if not skills:
        return F.lit("")
    label = f":+{GENERIC_POINTS}"
    if len(skills) > UNROLL_LIMIT:
        labels = listed([s + label for s in skills])
        hits = F.slice(positions(text, skills), 1, GENERIC_MAX_HITS)
        return F.array_join(F.transform(hits, lambda n: F.get(labels, n)), REASON_SEPARATOR)
    hits = [F.when(F.contains(text, F.lit(s)), F.lit(s + label)) for s in skills]
    return F.substring_index(
        F.concat_ws(REASON_SEPARATOR, *hits), REASON_SEPARATOR, GENERIC_MAX_HITS
    )


def capped_bump_points(joined: Column) -> Column:
    separators = F.length(joined) - F.length(F.replace(joined, F.lit(REASON_SEPARATOR), F.lit("")))
    return F.when(joined == "", 0).otherwise((separators + F.lit(1)) * GENERIC_POINTS)


def rule_hits(posts: DataFrame, rules: RuleSet) -> DataFrame:
    """One column per rule, beside the posting columns."""
    text = F.col(TEXT)
    hits = {
        "kill": kill_keyword(text, rules),
        "role_match": role_match(text, rules),
        **{f"group_{g.name}": contains_any(text, g.needles) for g in rules.groups},
        "generic": capped_bump(text, rules.generic_skills),
        "remote_boost": remote_boost(),
        "senior_penalty": senior_penalty(text, rules),
    }
    return posts.withColumn(TEXT, search_text()).withColumns(hits)


def _terms(rules: RuleSet) -> list[tuple[str, str, int, str]]:
    """Hit column, reason name, points and sign text, in reason order."""
    role = [("role_match", "role_match", rules.weight("role_match"), "+")]
    groups = [(f"group_{g.name}", g.name, rules.weight(g.weight_key), "+") for g in rules.groups]
    remote = [("remote_boost", "remote", rules.weight("remote"), "+")]
    senior = [("senior_penalty", "senior_penalty", rules.weight("senior_penalty"), "-")]
    return role + groups + remote + senior


def total_score(rules: RuleSet) -> Column:
    """Base plus every term, clamped at the end; zero for a killed posting."""
    points = [
        F.when(F.col(hit), F.lit(-weight if sign == "-" else weight).cast("bigint")).otherwise(0)
        for hit, _, weight, sign in _terms(rules)
    ]
    total = reduce(add, points, F.lit(BASE_SCORE).cast("bigint"))
    total = total + capped_bump_points(F.col("generic"))
    clamped = F.greatest(F.lit(MIN_SCORE), F.least(F.lit(MAX_SCORE), total))
    return F.when(F.col("kill").isNotNull(), F.lit(0)).otherwise(clamped).cast("int")


def joined_reasons(rules: RuleSet) -> Column:
    """Ordered reasons; the generic ones stand between the groups and remote."""
    label = {
        hit: F.when(F.col(hit), F.lit(f"{name}:{sign}{weight}"))
        for hit, name, weight, sign in _terms(rules)
    }
    remote, senior = label.pop("remote_boost"), label.pop("senior_penalty")
    generic = F.when(F.col("generic") != "", F.col("generic"))
    alive = F.concat_ws(REASON_SEPARATOR, *label.values(), generic, remote, senior)
    return F.coalesce(F.concat(F.lit("kill:"), F.col("kill")), alive)


def reason_list(joined: Column) -> Column:
    listed = F.slice(F.split(joined, REASON_SEPARATOR), 1, MAX_REASONS)
    return F.when(joined != "", listed).otherwise(F.array().cast("array<string>"))


def score(posts: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``score``, ``reasons`` and ``fingerprint`` to every posting."""
    key = fingerprint(F.col("source"), F.col("company"), F.col("url"))
    judged = rule_hits(posts, rules).select(
        *posts.columns,
        total_score(rules).alias("score"),
        joined_reasons(rules).alias("_reasons"),
        key.alias("fingerprint"),
    )
    listed = judged.withColumn("reasons", reason_list(F.col("_reasons")))
    return listed.select(*posts.columns, "score", "reasons", "fingerprint")
