"""First and last occurrence per fingerprint, and new against known.

All of these combine on the map side first, so a fingerprint that holds a third
of the rows sends one row per map task into the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "fingerprint"


def _first(columns: Sequence[str], order: Column) -> Column:
    return F.min_by(F.struct(*columns), order)


def dedup_first(rows: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """The first row of every fingerprint in arrival order."""
    columns = [c for c in rows.columns if c != KEY]
    first = rows.groupBy(KEY).agg(_first(columns, F.col(order)).alias("_first"))
    return first.select(KEY, "_first.*").select(*rows.columns)


def ends(rows: DataFrame, by: str, order: Sequence[str], last: bool = False) -> DataFrame:
    """The first row of every value of ``by`` in the order of some columns, and if wanted the last.

    For narrow rows, before they are joined and scored: where equal ``by`` means equal
    fingerprints, no other row can be the first or last of its fingerprint. A value's only
    row comes twice if the last is wanted. Of rows that agree in ``order`` the rest decides.
    """
    whole = F.struct(*order, *(c for c in rows.columns if c not in (by, *order)))
    found = rows.groupBy(by).agg(F.min(whole).alias("_end"), *([F.max(whole).alias("_last")] if last else []))
    if last:
        found = found.select(by, F.explode(F.array("_end", "_last")).alias("_end"))
    return found.select(by, "_end.*").select(*rows.columns)


def batch_summary(
    scored: DataFrame,
    keep: Sequence[str],
    order: str = "ingest_seq",
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per fingerprint: the first occurrence, and the last one's score.

    A repeat inside a batch is not new, but it still leaves its score behind.
    ``by`` names further key columns, such as the batch when there are several.
    """
    columns = [order, "score", *keep]
    grouped = scored.select(KEY, *by, *columns).groupBy(KEY, *by)
    summary = grouped.agg(
        _first(columns, F.col(order)).alias("_first"),
        F.max_by("score", order).alias("last_score"),
        F.count("*").alias("n_rows"),
    )
    return summary.select(
        KEY,
        *by,
        F.col("_first.score").alias("first_score"),
        "last_score",
        "n_rows",
        *[F.col(f"_first.{c}").alias(c) for c in (order, *keep)],
    )


def not_known(rows: DataFrame, *known: DataFrame) -> DataFrame:
    """Rows whose fingerprint occurs in none of the known sets.

    Every join is on the same key, so the rows are shuffled at most once, and a
    known set that is small by its statistics is broadcast by the optimizer.
    """
    for side in known:
        rows = rows.join(side.select(KEY), KEY, "left_anti")
    return rows


def not_known_small(rows: DataFrame, *known: DataFrame) -> DataFrame:
    """``not_known`` for a batch that is proven small, beside a large state.

    The batch's keys are broadcast and the state is read in place, so the large
    side is never shuffled. The caller checks the size.
    """
    keys = F.broadcast(rows.select(KEY))
    for side in known:
        touched = side.select(KEY).join(keys, KEY, "left_semi")
        rows = rows.join(touched, KEY, "left_anti")
    return rows


def duplicate_keys(state: DataFrame) -> DataFrame:
    """Fingerprints that break uniqueness; empty for a sound state."""
    counts = state.groupBy(KEY).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > 1)
