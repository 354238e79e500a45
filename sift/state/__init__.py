"""Append-only logs that remember what was seen."""
