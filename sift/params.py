"""Typed parameters: rules, thresholds and boards.

Everything here is small, lives on the driver and is folded into the plan as
literals. Values are checked when a parameter object is built, so that a bad
weight fails before a job starts and not in the middle of one.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

# Separates reasons while they are assembled as one string.
REASON_SEPARATOR = "\u001f"


@dataclass(frozen=True)
class SkillGroup:
    """Needles that together add one weight, once, under one reason name."""

    name: str
    weight_key: str
    needles: tuple[str, ...]


# ---- fixed values -----------------------------------------------------------
BASE_SCORE = 50
MIN_SCORE = 0
MAX_SCORE = 100
GENERIC_POINTS = 3
GENERIC_MAX_HITS = 4
MAX_REASONS = 10

DEFAULT_WEIGHTS = {
    "role_match": 20,
    "skill_sql": 20,
    "skill_python": 10,
    "skill_data_quality": 10,
    "remote": 15,
    "senior_penalty": 25,
}

SENIOR_MARKERS = ("principal", "staff", "head of", "director", "vp", "lead")
REMOTE_MARKERS = ("remote", "distributed", "anywhere")
DEFAULT_SOURCE = "greenhouse"

DEFAULT_GROUPS = (
    SkillGroup("sql", "skill_sql", ("sql",)),
    SkillGroup("python", "skill_python", ("python",)),
    SkillGroup("data_quality", "skill_data_quality", ("data quality", "testing", "dq")),
)
INSTANT_SCORE, DIGEST_SCORE, DIGEST_ITEMS = 85, 70, 15
# -----------------------------------------------------------------------------


def _needles(keywords: Iterable[str | None]) -> tuple[str, ...]:
    """Keywords without outer white space, in lower case and their given order.

    Null and blank ones are left out; they would occur in every text.
    """
    if isinstance(keywords, str):
        raise TypeError("expected a list of keywords, got a single string")
    trimmed = (keyword.strip() for keyword in keywords if keyword is not None)
    found = tuple(word.lower() for word in trimmed if word != "")
    for needle in found:
        if REASON_SEPARATOR in needle:
            raise ValueError(f"keyword holds a control character: {needle!r}")
    return found


@dataclass(frozen=True)
class RuleSet:
    """Ordered keyword rules. The order of every list is part of its meaning."""

    roles: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    weights: Mapping[str, int] = field(default_factory=dict)
    groups: tuple[SkillGroup, ...] = DEFAULT_GROUPS
    senior_markers: tuple[str, ...] = SENIOR_MARKERS

    def __post_init__(self) -> None:
        for name in ("roles", "skills", "exclude", "senior_markers"):
            object.__setattr__(self, name, _needles(getattr(self, name)))
        groups = tuple(replace(group, needles=_needles(group.needles)) for group in self.groups)
        object.__setattr__(self, "groups", groups)
        weights = {key: int(value) for key, value in dict(self.weights).items()}
        for key, value in weights.items():
            if abs(value) >= 2**31:
                raise ValueError(f"weight {key} is out of range: {value}")
        object.__setattr__(self, "weights", weights)
        for group in self.groups:
            if group.weight_key not in DEFAULT_WEIGHTS and group.weight_key not in weights:
                raise ValueError(f"group {group.name} has no weight {group.weight_key}")

    def weight(self, key: str) -> int:
        if key in self.weights:
            return self.weights[key]
        return DEFAULT_WEIGHTS[key]

    @property
    def generic_skills(self) -> tuple[str, ...]:
        """Skills that no named group already pays for; repeats are kept."""
        reserved = {needle for group in self.groups for needle in group.needles}
        return tuple(s for s in self.skills if s not in reserved)


@dataclass(frozen=True)
class Thresholds:
    instant: int = INSTANT_SCORE
    digest: int = DIGEST_SCORE
    digest_max_items: int = DIGEST_ITEMS

    def __post_init__(self) -> None:
        if self.digest_max_items < 0:
            raise ValueError("digest_max_items must not be negative")


@dataclass(frozen=True)
class Board:
    """A board token and the company name its postings carry."""

    token: str
    company_name: str | None = None

    @property
    def company(self) -> str:
        return self.token if self.company_name is None else self.company_name


@dataclass(frozen=True)
class Settings:
    thresholds: Thresholds
    boards: tuple[Board, ...]
    rules: RuleSet

    @classmethod
    def from_mapping(cls, data: Mapping[str, Any] | None) -> "Settings":
        """Build from the nested mapping a configuration file holds."""
        data = data or {}
        limits = _section(data, "pipeline")
        feed = _section(data, "sources", "greenhouse")
        scoring = _section(data, "scoring")
        usual = Thresholds()
        thresholds = Thresholds(
            int(limits.get("instant_threshold", usual.instant)),
            int(limits.get("digest_threshold", usual.digest)),
            int(limits.get("digest_max_items", usual.digest_max_items)),
        )
        tokens = (feed.get("boards") or ()) if feed.get("enabled", True) else ()
        rules = RuleSet(
            roles=_section(scoring, "include").get("roles") or (),
            skills=_section(scoring, "include").get("skills") or (),
            exclude=_section(scoring, "exclude").get("keywords") or (),
            weights=scoring.get("weights") or {},
        )
        return cls(thresholds, tuple(Board(token) for token in tokens), rules)


def _section(data: Mapping[str, Any], *path: str) -> Mapping[str, Any]:
    for key in path:
        data = data.get(key)
        if not isinstance(data, Mapping):
            return {}
    return data
