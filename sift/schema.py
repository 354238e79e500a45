"""Column sets of the three tables the engine works with."""

from __future__ import annotations

from pyspark.sql import types as T

# Arrival order. Source, board, landed file, offset inside it, place in its list.
INGEST_SEQ = T.StructType(
    [
        T.StructField("source_ord", T.IntegerType()),
        T.StructField("board_ord", T.IntegerType()),
        T.StructField("landed", T.StringType()),
        T.StructField("landed_pos", T.LongType()),
        T.StructField("pos", T.IntegerType()),
    ]
)

POSTING = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("remote", T.BooleanType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("description", T.StringType()),
        T.StructField("seniority", T.StringType()),
        T.StructField("contract_type", T.StringType()),
        T.StructField("salary_text", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("raw", T.VariantType()),
        T.StructField("ingest_seq", INGEST_SEQ),
    ]
)

# What an alert shows; the only posting columns that outlive scoring.
ALERT_FIELDS = ("title", "company", "location", "url", "source", "remote", "reasons")

SIGHTING = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("now", T.TimestampType()),
        T.StructField("first_score", T.IntegerType()),
        T.StructField("last_score", T.IntegerType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("ingest_seq", INGEST_SEQ),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("remote", T.BooleanType()),
        T.StructField("reasons", T.ArrayType(T.StringType())),
        T.StructField("batch_id", T.LongType()),
    ]
)

# A row that is no posting; what fails to be read has no place in a list.
REJECT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("ingest_seq", INGEST_SEQ),
        T.StructField("reject", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

# What a batch brought: sightings, and rejects in their place.
COLLECTED = T.StructType([*SIGHTING[:-1], T.StructField("reject", T.StringType()), SIGHTING["batch_id"]])

ROUTED = T.StructType(
    [
        T.StructField("route", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("score", T.IntegerType()),
        *[SIGHTING[name] for name in ("ingest_seq", *ALERT_FIELDS)],
        T.StructField("batch_id", T.LongType()),
    ]
)

NOTIFIED = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

# One row per fingerprint. The batch columns order two states against each other.
STATE = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("notified", T.BooleanType()),
        T.StructField("first_batch", T.LongType()),
        T.StructField("last_batch", T.LongType()),
        T.StructField("notified_batch", T.LongType()),
    ]
)
