"""Registered queries: one per operator, over the whole of its tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.catalog import views
from sift.catalog.views import (
    DOCUMENT_RULES,
    LONG_RULES,
    OFFER_RULES,
    PAGE_BOARDS,
    PAGE_RULES,
    THRESHOLDS,
    WEIGHTED_RULES,
)
from sift.functions.text import fingerprint
from sift.functions.times import parse_utc
from sift.operators import dedup, mapping, report, routing, scoring
from sift.params import RuleSet, Thresholds
from sift.plans import batch, replay
from sift.plans.batch import keyword_scorer
from sift.schema import ALERT_FIELDS
from sift.session import configure, working_folder
from sift.sources import boards, collect, payloads
from sift.sources.bodies import read_split_bodies
from sift.state.seen import (
    STATE_COLUMNS,
    SeenStore,
    merge_states,
    notified_states,
    sighting_states,
)

Query = Callable[[SparkSession, str], DataFrame]

OFFER_KEYS = ("l_orderkey", "l_linenumber", "url")
_STAMP = "yyyy-MM-dd HH:mm:ss"
EARLIER, NOW = (datetime(2024, 1, day, tzinfo=timezone.utc) for day in (1, 2))


def _joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


# ---- scoring ------------------------------------------------------------------


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = views.document_posts(spark, sf_dir).withColumn("t", scoring.search_text())
    return text.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = views.document_posts(spark, sf_dir)
    key = fingerprint(F.col("source"), F.col("company"), F.col("url"))
    return posts.select("doc_id", key.alias("fingerprint"))


def _offer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rule_hits(views.offers(spark, sf_dir), OFFER_RULES)


def kill_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offer_hits(spark, sf_dir).select(*OFFER_KEYS, "kill")


def role_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offer_hits(spark, sf_dir).select(*OFFER_KEYS, "role_match")


def skill_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"group_{g.name}" for g in OFFER_RULES.groups]
    return _offer_hits(spark, sf_dir).select(*OFFER_KEYS, *names)


def capped_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = views.document_posts(spark, sf_dir)
    hits = scoring.rule_hits(posts, DOCUMENT_RULES)
    generic = F.col("generic")
    return hits.select(
        "doc_id",
        F.replace(generic, F.lit(scoring.REASON_SEPARATOR), F.lit("|")).alias("generic"),
        scoring.capped_bump_points(generic).cast("int").alias("points"),
    )


def remote_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offer_hits(spark, sf_dir).select(*OFFER_KEYS, "remote", "remote_boost")


def senior_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offer_hits(spark, sf_dir).select(*OFFER_KEYS, "senior_penalty")


def _scored_offers(spark: SparkSession, sf_dir: str, rules: RuleSet = OFFER_RULES) -> DataFrame:
    return scoring.score(views.offers(spark, sf_dir), rules)


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_offers(spark, sf_dir).select(*OFFER_KEYS, _joined("reasons"))


def score_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_offers(spark, sf_dir).select(*OFFER_KEYS, "score")


def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored_offers(spark, sf_dir, WEIGHTED_RULES)
    return scored.select(*OFFER_KEYS, "score", _joined("reasons"))


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(views.document_posts(spark, sf_dir), DOCUMENT_RULES)
    return scored.select("doc_id", "fingerprint", "score", _joined("reasons"))


# ---- dedup and state ----------------------------------------------------------


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(views.offer_ends(spark, sf_dir), OFFER_RULES)
    first = dedup.dedup_first(scored.select("fingerprint", "ingest_seq", *OFFER_KEYS, "title", "score", "reasons"))
    return first.select("fingerprint", *OFFER_KEYS, "title", "score", _joined("reasons"))


def filter_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content is not among the labelled ones, first copy each."""
    scored = scoring.score(views.document_posts(spark, sf_dir), DOCUMENT_RULES)
    narrow = scored.select("fingerprint", "doc_id", "ingest_seq", "score")
    labels = views.table(spark, sf_dir, "labels").select("doc_id")
    known = narrow.join(labels, "doc_id", "left_semi")
    new = dedup.not_known(dedup.dedup_first(narrow), known)
    return new.select("fingerprint", "doc_id", "score")


def _event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.event_sightings(spark, sf_dir)
    keep = ("now", "source", "company", "title", "url")
    return sighting_states(dedup.batch_summary(events, keep, by=("batch_id",)))


def _state_columns(state: DataFrame) -> DataFrame:
    stamps = {c: F.date_format(c, _STAMP) for c in ("first_seen", "last_seen")}
    return state.select(*STATE_COLUMNS).withColumns(stamps)


def seen_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_columns(merge_states([_event_states(spark, sf_dir)]))


def mark_notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks by high events, one day early for views, and for unknown users too."""
    events = views.event_sightings(spark, sf_dir)
    early = F.when(F.col("company") == "view", 1).otherwise(0)
    high = events.where(F.col("score") >= 85)
    marks = high.select("fingerprint", (F.col("batch_id") - early).alias("batch_id"))
    unknown = high.select(
        fingerprint(F.lit("elsewhere"), F.col("company"), F.col("url")).alias("fingerprint"),
        "batch_id",
    )
    parts = [_event_states(spark, sf_dir), notified_states(marks.unionByName(unknown))]
    return merge_states(parts).select("fingerprint", "notified")


def seen_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once: in the raw sightings, and in the merged state."""
    sightings = views.event_sightings(spark, sf_dir).select("fingerprint")
    state = merge_states([_event_states(spark, sf_dir)]).select("fingerprint")
    parts = [
        part.select(F.lit(name).alias("part"), F.lit(0).cast("bigint").alias("n"), "*")
        for name, part in (("sightings", sightings), ("state", state))
    ]
    repeated = [
        dedup.duplicate_keys(part).select(F.lit(name).alias("part"), "n", "fingerprint")
        for name, part in (("sightings", sightings), ("state", state))
    ]
    rows = reduce(DataFrame.unionByName, [*parts, *repeated])
    return rows.groupBy("part").agg(
        F.count_if(F.col("n") == 0).alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.max("n").alias("most"),
    )


def seen_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ("source", "company", "title", "url")
    ends = views.offer_ends(spark, sf_dir, last=True)
    summary = dedup.batch_summary(scoring.score(ends, OFFER_RULES), keep).drop("n_rows")
    return report.seen_top(summary.withColumnRenamed("last_score", "score"))


# ---- routing ------------------------------------------------------------------


def _new_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(views.offer_ends(spark, sf_dir), OFFER_RULES)
    summary = dedup.batch_summary(scored, ALERT_FIELDS).drop("last_score", "n_rows")
    return summary.withColumnRenamed("first_score", "score")


def _routed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(_new_offers(spark, sf_dir), THRESHOLDS)


def route_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.route_instant(_new_offers(spark, sf_dir), THRESHOLDS)
    return rows.select("fingerprint", "title", "score")


def route_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.route_digest(_new_offers(spark, sf_dir), THRESHOLDS)
    return rows.select("fingerprint", "title", "score")


def digest_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = routing.route_digest(_new_offers(spark, sf_dir), THRESHOLDS)
    return routing.digest_cap(digest, THRESHOLDS).select("fingerprint", "title", "score")


def notified_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.alerted(_routed_offers(spark, sf_dir), THRESHOLDS).select("fingerprint", "route")


def format_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _new_offers(spark, sf_dir)
    return posts.select("fingerprint", routing.format_alert().alias("text"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = routing.alert_lines(_routed_offers(spark, sf_dir), THRESHOLDS)
    ordered = routing.in_printing_order(lines)
    return ordered.select("section", "is_alert", "fingerprint", "text")


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: which new postings deserve an alert, and how it reads."""
    chosen = routing.alerted(_routed_offers(spark, sf_dir), THRESHOLDS)
    return chosen.select(
        "route", "fingerprint", "score", "title", "company", "location", "remote", "url",
        _joined("reasons"), routing.format_alert().alias("text"),
    )


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one every executor shares."""
    return f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship, from landed bodies to alerts: pages of blogs were a run before.

    Bodies are parsed, mapped, freed of failing sources and scored; repeats and what
    the earlier run has seen are left out; the rest is routed and formatted. Both runs
    are those of ``plans.batch``, on a store of their own; each reads its feed once.
    """
    store, scorer = SeenStore(spark, _folder(spark, "seen"), buckets=8), keyword_scorer(PAGE_RULES)
    mapped = _isolated_pages(spark, sf_dir)
    batch.run_feed(mapped.where(F.col("source").startswith("blog.")), scorer, store, None, EARLIER, THRESHOLDS)
    chosen = batch.run_feed(mapped, scorer, store, None, NOW, THRESHOLDS)
    return chosen.select(
        "route", "fingerprint", "score", "title", "company", "location", "remote", "url", "source",
        _joined("reasons"), routing.format_alert().alias("text"),
    )


def filter_new_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content is not among the labelled ones, which are merged state by then."""
    scored = scoring.score(views.document_posts(spark, sf_dir), DOCUMENT_RULES)
    seq = F.struct(
        F.lit(0).alias("source_ord"), F.lit(0).alias("board_ord"), F.lit("documents").alias("landed"),
        F.col("doc_id").alias("landed_pos"), F.lit(0).alias("pos"),
    )
    rows = scored.withColumn("ingest_seq", seq)
    labels = views.table(spark, sf_dir, "labels").select("doc_id")
    store, limits = SeenStore(spark, _folder(spark, "seen"), buckets=8), Thresholds(instant=101, digest=0)
    batch.run_batch(rows.join(labels, "doc_id", "left_semi"), lambda d: d, store, 0, EARLIER, limits)
    store.compact(0)
    batch.run_batch(rows, lambda d: d, store, 1, NOW, limits)
    return store.routed_of(1).select("fingerprint", F.col("ingest_seq.landed_pos").alias("doc_id"), "score")


def split_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a board landed as one body, and the postings that several tasks read from it."""
    path, pages = _folder(spark, "bodies"), views.landed_pages(spark, sf_dir)
    texts = F.from_json("payload", "struct<jobs: array<string>>")["jobs"]
    jobs = pages.select(F.col("token").alias("board"), "landed_pos", F.posexplode(texts).alias("pos", "job"))
    lines = jobs.select("board", F.lit(1).alias("part"), "landed_pos", "pos", F.concat(F.lit(","), "job").alias("value"))
    ends = pages.select(F.col("token").alias("board")).distinct()
    for part, text in ((0, '{"jobs":[{}'), (2, "]}")):
        end = ends.select("board", F.lit(part).alias("part"), F.lit(None).cast("bigint").alias("landed_pos"), F.lit(0).alias("pos"), F.lit(text).alias("value"))
        lines = lines.unionByName(end)
    # A body is one file, and so is written by one task.
    ordered = lines.repartition("board").sortWithinPartitions("board", "part", "landed_pos", "pos")
    ordered.select("value", "board").write.partitionBy("board").text(path)
    found = mapping.read_members(payloads.job_rows(read_split_bodies(spark, path)))
    kept = mapping.required_filter(found)
    return kept.select("token", "title", "url", "location", F.md5("description").alias("description_md5"))


def long_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers scored by hundreds of words that only part names ever hold."""
    scored = scoring.score(views.offers(spark, sf_dir), LONG_RULES)
    return scored.select(*OFFER_KEYS, "score", _joined("reasons"))


def landed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages landed as JSON lines in board folders, and the jobs of configured boards."""
    path = _folder(spark, "landed")
    bodies = views.landed_pages(spark, sf_dir).select(F.col("payload").alias("value"), F.col("token").alias("board"))
    bodies.write.partitionBy("board").text(path)
    jobs = payloads.job_rows(payloads.read_payload_lines(spark, path, PAGE_BOARDS))
    url = F.try_variant_get("job", "$.absolute_url", "string")
    return jobs.select("token", "pos", url.alias("absolute_url"))


def run_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches of the event table, their alerts and the state they leave."""
    events = views.event_sightings(spark, sf_dir)
    keep = ("source", "company", "title", "url")
    return _state_columns(replay.replay_state(events, THRESHOLDS, keep))


# ---- sources and mapping --------------------------------------------------------


def board_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = payloads.job_rows(views.landed_pages(spark, sf_dir))
    url = F.try_variant_get("job", "$.absolute_url", "string")
    return jobs.select("token", "landed_pos", "pos", url.alias("absolute_url"))


def _board_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = views.landed_pages(spark, sf_dir)
    joined = boards.join_boards(landed, boards.boards_frame(spark, PAGE_BOARDS))
    return boards.with_ingest_seq(payloads.job_rows(joined))


def boards_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = views.landed_pages(spark, sf_dir).drop("payload")
    joined = boards.join_boards(landed, boards.boards_frame(spark, PAGE_BOARDS))
    return joined.select("token", "company", "board_ord", "landed_pos")


def _mapped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_jobs(_board_jobs(spark, sf_dir), "pages")


def _place() -> list[Column]:
    return [F.col(f"ingest_seq.{c}").alias(c) for c in ("board_ord", "landed_pos", "pos")]


def map_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = mapping.postings(_mapped_pages(spark, sf_dir))
    return posts.select(
        *_place(), "title", "company", "location", "url", "source", "remote",
        F.date_format("published_at", _STAMP).alias("published_at"),
        F.md5("description").alias("description_md5"),
        F.size("tags").alias("n_tags"),
        F.try_variant_get("raw", "$.absolute_url", "string").alias("raw_url"),
    )


def _page_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.read_members(payloads.job_rows(views.landed_pages(spark, sf_dir)))


def required_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mapping.required_filter(_page_jobs(spark, sf_dir))
    return kept.select("landed_pos", "pos", "title", "url")


def poly_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_jobs(spark, sf_dir).select("landed_pos", "pos", "location")


def assemble_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _page_jobs(spark, sf_dir)
    text = F.col("description")
    return jobs.select(
        "landed_pos", "pos", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5")
    )


def remote_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = mapping.remote_flag(F.col("title"), F.col("location"), F.col("description"))
    return _page_jobs(spark, sf_dir).select("landed_pos", "pos", flag.alias("remote"))


def parse_utc_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in several ISO forms, and read back."""
    key = F.col("o_orderkey")
    base = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86400
    at = F.timestamp_seconds(base + key % 86400)
    form = key % 9
    text = (
        F.when(form == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'+05:30'"))
        .when(form == 3, F.date_format(at, "yyyyMMdd'T'HHmmss'-0330'"))
        .when(form == 4, F.date_format(at, "yyyy-MM-dd"))
        .when(form == 5, F.date_format(at, "yyyy-MM-dd'x'HH:mm'-23:59'"))
        .when(form == 6, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss',5+00'"))
        .when(form == 7, F.date_format(at, "yyyy-MM"))
        .otherwise(F.date_format(at, "HH:mm:ss"))
    )
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("written"))
    parsed = parse_utc(F.col("written"))
    return orders.select(
        "o_orderkey",
        F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"),
    )


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources appended; each keeps its place and lacks some columns."""
    batches = [
        mapping.postings(_mapped_pages(spark, sf_dir)).drop("ingest_seq"),
        views.document_posts(spark, sf_dir).drop("ingest_seq"),
        views.offers(spark, sf_dir).drop("ingest_seq"),
    ]
    numbered = [b.withColumn("source_ord", F.lit(i)) for i, b in enumerate(batches)]
    whole = collect.union_sources(numbered)
    return whole.select("source_ord", "source", "company", "title", "url", "doc_id", "l_orderkey")


def _isolated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host is a source; mobile pages linked to their top carry a numeric title."""
    numeric = F.col("url").endswith("#top") & F.col("host").startswith("m.")
    landed = views.landed_pages(spark, sf_dir, numeric)
    jobs = payloads.job_rows(landed.withColumns({"company": F.col("token"), "board_ord": F.lit(0)}))
    return mapping.map_jobs(boards.with_ingest_seq(jobs), F.col("host"))


def source_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = collect.isolate_sources(_isolated_pages(spark, sf_dir))
    return posts.select("source", "title", "url", *_place())


def source_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = _isolated_pages(spark, sf_dir)
    return mapping.rejects(mapped).select("source", "reject", *_place())


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per host after isolation, zero for the hosts that failed."""
    mapped = _isolated_pages(spark, sf_dir)
    return report.source_counts(mapped)


REGISTERED: dict[str, Query] = {
    "run_once": run_once,
    "run_feed": run_feed,
    "run_replay": run_replay,
    "long_lists": long_lists,
    "landed_lines": landed_lines,
    "split_bodies": split_bodies,
    "search_text": search_text,
    "fingerprint": fingerprints,
    "kill_list": kill_list,
    "role_match": role_match,
    "skill_groups": skill_groups,
    "capped_bump": capped_bump,
    "remote_boost": remote_boost,
    "senior_penalty": senior_penalty,
    "reasons": reasons,
    "score_default": score_default,
    "score_weighted": score_weighted,
    "score_documents": score_documents,
    "dedup_first": dedup_first,
    "filter_new": filter_new,
    "filter_new_merged": filter_new_merged,
    "seen_state": seen_state,
    "mark_notified": mark_notified,
    "seen_unique": seen_unique,
    "seen_top20": seen_top20,
    "route_instant": route_instant,
    "route_digest": route_digest,
    "digest_cap": digest_cap,
    "notified_set": notified_set,
    "format_alert": format_alert,
    "alerts": alerts,
    "board_payload_rows": board_payload_rows,
    "boards_join": boards_join,
    "map_posting": map_posting,
    "required_filter": required_filter,
    "poly_location": poly_location,
    "assemble_description": assemble_description,
    "remote_flag": remote_flag,
    "parse_utc": parse_utc_orders,
    "union_sources": union_sources,
    "source_isolation": source_isolation,
    "source_quarantine": source_quarantine,
    "source_counts": source_counts,
}


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _configured(query) for name, query in REGISTERED.items()}
