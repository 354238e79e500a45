"""Which new postings are alerted, and how an alert reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.functions.text import blank_if_null
from sift.params import Thresholds

INSTANT = "instant"
DIGEST = "digest"

# ---- fixed values -----------------------------------------------------------
HEADINGS = {
    INSTANT: "\n=== INSTANT (high match) ===",
    DIGEST: "\n=== DIGEST (medium match) ===",
}
ALERT_LAYOUT = (
    "[%3d] %s\n"
    "      %s — %s — %s\n"
    "      %s\n"
    "      reasons: %s\n"
)
NO_LOCATION = "N/A"
REMOTE_YES = "remote"
REMOTE_NO = "onsite/unknown"
NO_REASONS = "-"
# -----------------------------------------------------------------------------


def route_name(score: Column, thresholds: Thresholds) -> Column:
    return F.when(score >= thresholds.instant, INSTANT).when(score >= thresholds.digest, DIGEST)


def route(new_rows: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Name the route of every new posting; those below both are left out."""
    routed = new_rows.withColumn("route", route_name(F.col("score"), thresholds))
    return routed.where(F.col("route").isNotNull())


def route_instant(new_rows: DataFrame, thresholds: Thresholds) -> DataFrame:
    return new_rows.where(F.col("score") >= thresholds.instant)


def route_digest(new_rows: DataFrame, thresholds: Thresholds) -> DataFrame:
    score = F.col("score")
    return new_rows.where((score >= thresholds.digest) & (score < thresholds.instant))


def digest_cap(
    digest: DataFrame, thresholds: Thresholds, order: str = "ingest_seq"
) -> DataFrame:
    """The first digest items by arrival, not by score."""
    return digest.orderBy(order).limit(thresholds.digest_max_items)


def alerted(routed: DataFrame, thresholds: Thresholds, order: str = "ingest_seq") -> DataFrame:
    """Every instant row and the capped digest rows."""
    instant = routed.where(F.col("route") == INSTANT)
    digest = routed.where(F.col("route") == DIGEST)
    return instant.unionByName(digest_cap(digest, thresholds, order))


def format_alert() -> Column:
    location = F.when(F.col("location") != "", F.col("location")).otherwise(NO_LOCATION)
    remote = F.when(F.col("remote"), REMOTE_YES).otherwise(REMOTE_NO)
    reasons = F.col("reasons")
    shown = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise(NO_REASONS)
    return F.format_string(
        ALERT_LAYOUT,
        F.col("score"),
        blank_if_null(F.col("title")),
        blank_if_null(F.col("company")),
        location,
        remote,
        blank_if_null(F.col("url")),
        shown,
    )


def section_headings(routed: DataFrame) -> DataFrame:
    """One heading per route that has rows; the cap is not looked at."""
    heading = F.when(F.col("route") == INSTANT, HEADINGS[INSTANT]).otherwise(HEADINGS[DIGEST])
    return routed.select("route").distinct().withColumn("text", heading)


def alert_lines(
    routed: DataFrame, thresholds: Thresholds, order: str = "ingest_seq"
) -> DataFrame:
    """Headings and alerts with the columns that put them in printing order."""
    lines = alerted(routed, thresholds, order).withColumn("text", format_alert())
    both = section_headings(routed).unionByName(
        lines.select("route", "fingerprint", order, "text"), allowMissingColumns=True
    )
    section = F.when(F.col("route") == INSTANT, 1).otherwise(2)
    is_alert = F.col("fingerprint").isNotNull().cast("int")
    return both.withColumns({"section": section, "is_alert": is_alert})


def in_printing_order(lines: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """A range-partitioned sort, so long instant lists spread over the cluster."""
    return lines.orderBy("section", "is_alert", order)
