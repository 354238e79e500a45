"""Payload objects to postings.

``map_jobs`` is a chain of narrow projections, each of which reads the columns
of the one before, so that no member is extracted twice. A row ends up as a
posting, as a row without a title or a url (dropped), or as a reject with the
reason that would fail its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.functions.text import blank_if_null, contains_any, strip
from sift.functions.times import parse_utc
from sift.functions.variants import members, not_text, string_or_null
from sift.params import DEFAULT_SOURCE, REMOTE_MARKERS
from sift.schema import POSTING

# The text members of a content object, in their order.
DESCRIPTION_PARTS = ("description", "requirements", "responsibilities")


def poly_location(place: Column, location: Column) -> Column:
    """An object gives its name, a string gives itself, all else is blank."""
    return strip(blank_if_null(F.coalesce(place, location)))


def assemble_description(parts: list[Column]) -> Column:
    """Non-blank parts with a blank line between."""
    return F.concat_ws("\n\n", *[F.when(part != "", part) for part in parts])


def remote_flag(title: Column, location: Column, description: Column) -> Column:
    """True when a marker occurs, otherwise NULL; never False."""
    text = F.lower(F.concat_ws(" ", title, location, description))
    return F.when(contains_any(text, REMOTE_MARKERS), F.lit(True))


def read_members(jobs: DataFrame) -> DataFrame:
    """Split the members of ``sources.payloads.job_rows`` into typed columns."""
    opened = jobs.withColumns(
        {
            "_title": string_or_null(F.col("part.title")),
            "_url": string_or_null(F.col("part.absolute_url")),
            "_location": string_or_null(F.col("part.location")),
            "_place": members(F.col("part.location"), "name").getField("name"),
            "_content": members(F.col("part.content"), *DESCRIPTION_PARTS),
            "_updated": string_or_null(F.col("part.updated_at")),
            "_bad_title": not_text(F.col("part.title")),
            "_bad_url": not_text(F.col("part.absolute_url")),
        }
    )
    texts = opened.withColumns(
        {
            "_name": string_or_null(F.col("_place")),
            "_bad_name": F.coalesce(not_text(F.col("_place")), F.lit(False)),
            **{f"_{p}": string_or_null(F.col(f"_content.{p}")) for p in DESCRIPTION_PARTS},
        }
    )
    trimmed = texts.withColumns(
        {
            "title": strip(blank_if_null(F.col("_title"))),
            "url": strip(blank_if_null(F.col("_url"))),
            "location": poly_location(F.col("_name"), F.col("_location")),
            "published_at": parse_utc(F.col("_updated")),
            **{f"_{p}": strip(F.col(f"_{p}")) for p in DESCRIPTION_PARTS},
        }
    )
    # The order below is the order in which the checks can fail: a location is
    # looked at only when title and url are both there.
    member_reject = F.coalesce(
        F.when(F.col("part").isNull(), "job is not an object"),
        F.when(F.col("_bad_title"), "title is not text"),
        F.when(F.col("_bad_url"), "url is not text"),
        F.when(has_required_fields() & F.col("_bad_name"), "location name is not text"),
    )
    mapped = trimmed.withColumns(
        {
            "description": assemble_description([F.col(f"_{p}") for p in DESCRIPTION_PARTS]),
            "reject": F.coalesce(
                F.col("payload_reject"), F.when(F.col("pos").isNotNull(), member_reject)
            ),
        }
    )
    inner = [c for c in mapped.columns if c.startswith("_")]
    return mapped.drop("part", "payload_reject", *inner)


def has_required_fields() -> Column:
    return (F.col("title") != "") & (F.col("url") != "")


def required_filter(mapped: DataFrame) -> DataFrame:
    return mapped.where(has_required_fields())


def map_jobs(jobs: DataFrame, source: str | Column = DEFAULT_SOURCE) -> DataFrame:
    """Rows of ``sources.payloads.job_rows`` to the posting columns and ``reject``."""
    mapped = read_members(jobs)
    absent = F.lit(None).cast("string")
    columns = {
        "source": source if isinstance(source, Column) else F.lit(source),
        "remote": remote_flag(F.col("title"), F.col("location"), F.col("description")),
        "seniority": absent,
        "contract_type": absent,
        "salary_text": absent,
        "tags": F.array().cast("array<string>"),
        "raw": F.col("job"),
    }
    return mapped.withColumns(columns).select(*POSTING.fieldNames(), "reject")


def postings(mapped: DataFrame) -> DataFrame:
    """The rows of ``map_jobs`` that are postings."""
    return required_filter(mapped.where(F.col("reject").isNull())).drop("reject")


def rejects(mapped: DataFrame) -> DataFrame:
    """The rows of ``map_jobs`` that would fail their source."""
    return mapped.where(F.col("reject").isNotNull()).select(
        "source", "company", "ingest_seq", "reject"
    )
