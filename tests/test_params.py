from __future__ import annotations

import pytest

from sift.params import Board, RuleSet, Settings, SkillGroup, Thresholds


def test_settings_from_an_empty_mapping_are_the_defaults():
    for data in (None, {}, {"pipeline": None, "scoring": {"include": None}}):
        assert Settings.from_mapping(data) == Settings(Thresholds(85, 70, 15), (), RuleSet())


def test_settings_from_a_full_mapping():
    data = {
        "pipeline": {"instant_threshold": 90, "digest_threshold": "60", "digest_max_items": 3},
        "sources": {"greenhouse": {"enabled": True, "boards": ["a", "b", "a"]}},
        "scoring": {
            "include": {"roles": ["Data Analyst "], "skills": ["SQL", "dbt", ""]},
            "exclude": {"keywords": [" Intern"]},
            "weights": {"remote": 3.7},
        },
    }
    got = Settings.from_mapping(data)
    assert got.thresholds == Thresholds(90, 60, 3)
    assert got.boards == (Board("a"), Board("b"), Board("a"))
    assert got.rules.roles == ("data analyst",) and got.rules.exclude == ("intern",)
    assert got.rules.generic_skills == ("dbt",)
    assert (got.rules.weight("remote"), got.rules.weight("role_match")) == (3, 20)


def test_a_source_that_is_off_has_no_boards():
    data = {"sources": {"greenhouse": {"enabled": False, "boards": ["a"]}}}
    assert Settings.from_mapping(data).boards == ()


def test_company_name_defaults_to_the_token():
    assert Board("a").company == "a" and Board("a", "").company == ""


def test_negative_cap_is_refused():
    with pytest.raises(ValueError):
        Thresholds(digest_max_items=-1)


def test_group_needles_are_normalised():
    rules = RuleSet(skills=("SQL", "dbt"), groups=(SkillGroup("sql", "skill_sql", (" SQL ", "")),))
    assert rules.groups[0].needles == ("sql",) and rules.generic_skills == ("dbt",)
