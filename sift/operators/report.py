"""Ad-hoc reports over the seen state and the collected sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.operators.mapping import has_required_fields


def seen_top(state: DataFrame, n: int = 20) -> DataFrame:
    """Best scores first; the fingerprint settles ties."""
    ordered = state.orderBy(F.col("score").desc(), "fingerprint").limit(n)
    return ordered.select("score", "company", "title", "source", "fingerprint")


def source_counts(mapped: DataFrame) -> DataFrame:
    """Postings per source of ``map_jobs`` rows, zero for a source that holds a reject.

    One reading of the feed and one shuffle, combined before it.
    """
    bad = F.col("reject").isNotNull()
    counts = mapped.groupBy("source").agg(
        F.count_if(bad).alias("n_bad"), F.count_if(~bad & has_required_fields()).alias("n_good")
    )
    n_posts = F.when(F.col("n_bad") > 0, F.lit(0)).otherwise(F.col("n_good")).cast("bigint")
    message = F.format_string("%s: %d posts", F.col("source"), n_posts)
    return counts.select("source", n_posts.alias("n_posts"), message.alias("message"))
