"""The test tables seen as postings, sightings and landed payloads.

The words of the tables hold none of the usual rule words, so part names are
re-worded. Every view is lazy and covers its whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.functions.text import fingerprint
from sift.operators.dedup import ends
from sift.operators.mapping import remote_flag
from sift.params import Board, RuleSet, Thresholds

REWORDED = {
    "widget": "data analyst",
    "gear": "sql",
    "red": "staff",
    "cold": "remote",
    "gizmo": "intern",
}

OFFER_RULES = RuleSet(
    roles=("analytics engineer", "data analyst"),
    skills=(
        "sql", "ring", "plate", "brand#1", "small", "large", "standard", "an", "data quality", "o",
    ),
    exclude=("tirocinio", "intern", "blue anvil"),
)

WEIGHTED_RULES = RuleSet(
    roles=OFFER_RULES.roles,
    skills=OFFER_RULES.skills,
    exclude=OFFER_RULES.exclude,
    weights={
        "role_match": 30,
        "skill_sql": -4,
        "skill_data_quality": 12.9,
        "remote": -7,
        "senior_penalty": -3,
    },
)

DOCUMENT_RULES = RuleSet(
    roles=("license",), skills=("ment", "tion", "ung", "que", "des"), exclude=("token",)
)

PAGE_RULES = RuleSet(
    roles=("the", "les", "der", "los"), skills=("ment", "tion", "ung", "des"), exclude=("que en",)
)

# Longer than any list that is unrolled; most words occur nowhere.
LONG_RULES = RuleSet(
    roles=tuple(f"role {n}" for n in range(300)) + ("data analyst",),
    skills=tuple(f"skill {n}" for n in range(300)) + ("ring", "plate", "small", "large", "an"),
    exclude=tuple(f"word {n}" for n in range(300)) + ("intern",),
)

THRESHOLDS = Thresholds()

# One board is listed twice, and one never lands anything.
PAGE_BOARDS = (
    Board("en", "English pages"),
    Board("fr", "Pages françaises"),
    Board("de"),
    Board("fr", "Pages françaises, again"),
    Board("it", "Pagine italiane"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_returnflag", "l_linestatus",
    )


def offer_ends(spark: SparkSession, sf_dir: str, last: bool = False) -> DataFrame:
    """``offers``, but only by the first line of each part, and if wanted by its last.

    All that makes the fingerprint of an offer is its part's, so these hold the first
    (and last) offer of every fingerprint. Lines are combined by part while they are
    narrow, before they are joined and scored.
    """
    order = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return offers(spark, sf_dir, ends(order_lines(spark, sf_dir), "l_partkey", order, last))


def offers(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Each order line, or each of ``lines``, as a sighting of the posting of its part."""
    lines = order_lines(spark, sf_dir) if lines is None else lines
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    title = reduce(
        lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])),
        REWORDED.items(),
        F.col("p_name"),
    )
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return joined.withColumn("title", title).select(
        "l_orderkey",
        "l_linenumber",
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
        ).alias("ingest_seq"),
        "title",
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("location"),
        F.concat(F.lit("https://parts.example/"), F.col("p_partkey").cast("string")).alias("url"),
        F.lit("catalog").alias("source"),
        F.coalesce(
            remote_flag(F.col("title"), F.col("p_type"), F.lit("")), F.when(flag == "N", F.lit(False))
        ).alias("remote"),
        F.lit("").alias("description"),
        F.when((flag == "R") & (status == "F"), "lead").alias("seniority"),
        F.when(flag == "A", "testing").alias("contract_type"),
        F.lit(None).cast("string").alias("salary_text"),
        F.array(flag, status).alias("tags"),
    )


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a posting; exact copies share their url."""
    absent = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("doc_id").alias("ingest_seq"),
        F.col("source").alias("title"),
        F.col("lang").alias("company"),
        F.lit("").alias("location"),
        F.concat(F.lit("https://docs.example/"), F.sha2("text", 256)).alias("url"),
        F.lit("documents").alias("source"),
        F.lit(None).cast("boolean").alias("remote"),
        F.col("text").alias("description"),
        absent.alias("seniority"),
        absent.alias("contract_type"),
        absent.alias("salary_text"),
        F.array().cast("array<string>").alias("tags"),
    )


def event_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a scored sighting, one batch per day, in event order."""
    day = F.unix_date(F.col("ts").cast("date"))
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        fingerprint(F.lit("events"), kind, user).alias("fingerprint"),
        day.cast("bigint").alias("batch_id"),
        F.timestamp_seconds((day + 1).cast("bigint") * 86400).alias("now"),
        F.least(F.lit(100), F.floor("value").cast("int")).alias("score"),
        F.col("event_id").alias("ingest_seq"),
        F.lit("events").alias("source"),
        kind.alias("company"),
        F.concat(kind, F.lit(" "), F.col("event_id").cast("string")).alias("title"),
        user.alias("url"),
    )


def _page_columns(pages: DataFrame) -> DataFrame:
    anchors = r'<a href="([^"]*)">([^<]*)</a>'
    return pages.select(
        "page_id",
        "url",
        "html",
        F.regexp_extract("url", "^https?://[^/]+/([^/?#]+)", 1).alias("token"),
        F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"),
        F.regexp_extract_all("html", F.lit(anchors), F.lit(1)).alias("hrefs"),
        F.regexp_extract_all("html", F.lit(anchors), F.lit(2)).alias("labels"),
    )


def _variant(text: Column) -> Column:
    return text.cast("variant")


def _page_location(host: Column, page_id: Column) -> Column:
    place = F.replace(host, F.lit("blog."), F.lit("Anywhere, "))
    padded = F.concat(F.lit("\n "), place, F.lit(" "))
    form = page_id % 4
    return (
        F.when(form == 0, F.to_variant_object(F.struct(padded.alias("name"))))
        .when(form == 1, _variant(padded))
        .when(form == 2, page_id.cast("variant"))
    )


def _page_content(html: Column, heading: Column, page_id: Column) -> Column:
    form = page_id % 3
    full = F.struct(
        F.concat(F.lit("  "), html).alias("description"),
        F.lit(" \t ").alias("requirements"),
        F.concat(heading, F.lit("\n")).alias("responsibilities"),
    )
    odd = F.struct(page_id.alias("description"), heading.alias("requirements"))
    return (
        F.when(form == 0, F.to_variant_object(full))
        .when(form == 1, _variant(html))
        .otherwise(F.to_variant_object(odd))
    )


def _page_updated(page_id: Column) -> Column:
    at = F.timestamp_seconds(F.lit(1704067200) + page_id * 61)
    form = page_id % 5
    return (
        F.when(form == 0, _variant(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .when(form == 1, _variant(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:30'")))
        .when(form == 2, _variant(F.date_format(at, "yyyyMMdd'T'HHmm'-0500'")))
        .when(form == 3, _variant(F.date_format(at, "yyyy-MM")))
        .otherwise(page_id.cast("variant"))
    )


def landed_pages(
    spark: SparkSession, sf_dir: str, numeric_title: Column | None = None
) -> DataFrame:
    """Each page as a landed body: the page itself, then each link on it.

    ``numeric_title`` marks pages whose title is written as a number.
    """
    page = _page_columns(table(spark, sf_dir, "pages"))
    page_id = F.col("page_id")
    title = _variant(F.concat(F.lit("  "), F.col("title"), F.lit("\r\n")))
    if numeric_title is not None:
        title = F.when(numeric_title, page_id.cast("variant")).otherwise(title)
    own = F.struct(
        title.alias("title"),
        _variant(F.col("url")).alias("absolute_url"),
        _page_location(F.col("host"), page_id).alias("location"),
        _page_content(F.col("html"), F.col("heading"), page_id).alias("content"),
        _page_updated(page_id).alias("updated_at"),
    )
    nothing = F.lit(None).cast("variant")
    links = F.transform(
        F.arrays_zip("labels", "hrefs"),
        lambda link: F.struct(
            _variant(F.replace(link["labels"], F.lit("the"), F.lit(" "))).alias("title"),
            _variant(F.concat(F.lit("https://"), F.col("host"), link["hrefs"])).alias(
                "absolute_url"
            ),
            nothing.alias("location"),
            nothing.alias("content"),
            nothing.alias("updated_at"),
        ),
    )
    body = F.to_json(F.struct(F.concat(F.array(own), links).alias("jobs")))
    return page.select(
        "token",
        F.lit("pages").alias("landed"),
        page_id.alias("landed_pos"),
        body.alias("payload"),
        "host",
    )
