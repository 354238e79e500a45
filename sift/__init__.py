"""Find the few postings worth a person's attention in a large feed."""

from sift.params import Board, RuleSet, SkillGroup, Thresholds
from sift.session import configure

__all__ = ["Board", "RuleSet", "SkillGroup", "Thresholds", "configure"]
