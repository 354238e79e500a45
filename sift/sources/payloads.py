"""Landed board payloads to one row per job.

A landed row is ``(token, landed, landed_pos, payload)``: the board token, where
the body was landed, its offset there, and the body ``{"jobs": [...]}`` as text.
Bodies may come from one file each (``read_payload_files``) or from any table or
stream that has those columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.functions.variants import kind, members
from sift.params import Board

# Options of the reader that takes over for bodies too large for one variant.
_STRICT_JSON = {
    "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxStringLen": str((1 << 31) - 1),
    "columnNameOfCorruptRecord": "_corrupt",
}
TOO_LARGE = "a value of the job is too large"
# A job whose text is shorter always fits into a variant; others may have to be read member by member.
SURE_TO_FIT = 1 << 24

# What a posting is made of. All else stays in the raw object.
JOB_MEMBERS = ("title", "absolute_url", "location", "content", "updated_at")

TOKEN_PATTERN = "/board=([^/]+)/"
_LINE_NUMBERS = (1 << 33) - 1


def _landed_columns(files: DataFrame, token: Column, position: Column) -> DataFrame:
    return files.select(
        token.alias("token"),
        F.col("_metadata.file_path").alias("landed"),
        position.alias("landed_pos"),
        F.col("value").alias("payload"),
    )


def _landing(spark: SparkSession, path: str, boards: Sequence[Board] | None, whole: bool) -> DataFrame:
    # The board is a partition column and a string whatever it looks like.
    reader = spark.read.format("text").schema("value string, board string").option("wholetext", whole)
    files = reader.load(path)
    if boards is None:
        return files
    return files.where(F.col("board").isin(sorted({b.token for b in boards})))


def read_payload_files(
    spark: SparkSession, path: str, boards: Sequence[Board] | None = None
) -> DataFrame:
    """Bodies landed as ``<path>/board=<token>/<name>.json``, one per file.

    ``path`` is what one run takes in, such as the snapshot of a day; folders of boards
    that are not among ``boards`` are not read. Names must sort in order of arrival:
    they decide which of two postings with one fingerprint came first.
    """
    files = _landing(spark, path, boards, whole=True)
    return _landed_columns(files, F.col("board"), F.lit(0).cast("bigint"))


def read_payload_lines(
    spark: SparkSession, path: str, boards: Sequence[Board] | None = None
) -> DataFrame:
    """Bodies landed as lines of ``<path>/board=<token>/<name>``; blank lines are left out.

    A large file is split over tasks. The offset of a body grows along its file: where
    its part of the file begins, and its row's number among those of the task, which
    are fewer than the bytes of any part.
    """
    files = _landing(spark, path, boards, whole=False)
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(_LINE_NUMBERS))
    rows = _landed_columns(files, F.col("board"), F.col("_metadata.file_block_start") + number)
    return rows.where(F.trim("payload") != "")


def stream_payload_files(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """The same folder as a stream of files.

    All that has landed is one batch, as in a run by hand. ``max_files`` makes smaller
    batches, and with them what a batch means to the digest cap, to repeats and to
    failing sources.
    """
    reader = spark.readStream.format("text").option("wholetext", True)
    reader = reader.option("recursiveFileLookup", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A plus sign is an ordinary character in a path.
    encoded = F.regexp_extract("_metadata.file_path", TOKEN_PATTERN, 1)
    token = F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    return _landed_columns(reader.load(path), token, F.lit(0).cast("bigint"))


def parsed_body(wrapped: Column) -> Column:
    """A body in a list as a variant; NULL if it is no JSON or larger than a variant may be."""
    return F.try_parse_json(wrapped)


def body_variants(wrapped: Column) -> Column:
    """The jobs of a body that is too large for one variant, each a variant of its own."""
    parsed = F.from_json(wrapped, "array<struct<jobs: array<variant>>>", _STRICT_JSON)
    return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)).getField("jobs"))


def _no_variant(text: Column) -> Column:
    """True for a job that is too large for one variant."""
    return (F.length(text) >= SURE_TO_FIT) & F.try_parse_json(text).isNull()


def _member_by_member(text: Column) -> Column:
    """The members of a job that is no variant, each a variant of its own."""
    fields = ", ".join(f"{name}: variant" for name in JOB_MEMBERS)
    return F.from_json(text, f"struct<{fields}, _corrupt: string>", _STRICT_JSON)


def _opened(job: Column, reject: Column) -> Column:
    return F.struct(job.alias("job"), members(job, *JOB_MEMBERS).alias("part"), reject.alias("reject"))


def _opened_text(text: Column) -> Column:
    """A job from its text. One that is no variant keeps its members, but no raw object."""
    job = F.try_parse_json(text)
    apart = F.when(_no_variant(text), _member_by_member(text))
    own = F.struct(*[apart.getField(name).alias(name) for name in JOB_MEMBERS])
    is_object = apart.getField("_corrupt").isNull() & F.startswith(text, F.lit("{"))
    part = F.coalesce(members(job, *JOB_MEMBERS), F.when(apart.isNotNull() & is_object, own))
    reject = F.when(apart.isNotNull() & ~is_object, TOO_LARGE)
    return F.struct(job.alias("job"), part.alias("part"), reject.alias("reject"))


def job_rows(payloads: DataFrame) -> DataFrame:
    """One row per job: its place in the list, the object, and its members.

    The body is wrapped in a list first, so that text after the object makes it
    invalid. A body without jobs to give keeps one row with a NULL ``pos``; its
    ``payload_reject`` says why, or is NULL when it is a valid empty body.
    """
    wrapped = F.concat(F.lit("["), F.col("payload"), F.lit("]"))
    parsed = payloads.withColumn("_body", parsed_body(wrapped))
    # A body that is no variant is read member by member, each job a variant of its own,
    # and job by job as text only where a job is too large for that.
    no_body = F.col("_body").isNull()
    texts = F.when(no_body, F.from_json(wrapped, "array<struct<jobs: string>>", _STRICT_JSON))
    parsed = parsed.withColumns(
        {
            "_root": members(F.try_variant_get("_body", "$[0]", "variant"), "jobs"),
            "_more": F.try_variant_get("_body", "$[1]", "variant").isNotNull(),
            "_texts": texts,
        }
    )
    listed = F.try_variant_get("_root.jobs", "$", "array<variant>")
    text = F.get("_texts", F.lit(0)).getField("jobs")
    whole = F.when(no_body, body_variants(wrapped)).when(~F.col("_more"), listed)
    opened = parsed.withColumns({"_text": text, "_listed": whole})
    is_list = F.col("_listed").isNull() & (F.size("_texts") == 1) & F.startswith("_text", F.lit("["))
    split = F.when(is_list, F.from_json("_text", "array<string>", _STRICT_JSON))
    opened = opened.withColumn("_split", split)
    opened = opened.withColumn("_listed_texts", F.when(F.exists("_split", _no_variant), F.col("_split")))
    opened = opened.withColumn("payload_reject", _payload_reject())
    kept = [c for c in payloads.columns if c != "payload"]
    # The generator is outer to keep bodies that give no job, and because the
    # filter inferred for an inner one would parse every body again. Objects are
    # opened inside it: filters on members then stop at the generator instead of
    # opening every object anew.
    pairs = F.coalesce(
        F.transform("_listed", lambda job: _opened(job, F.lit(None).cast("string"))),
        F.transform("_listed_texts", _opened_text),
    )
    rows = opened.select(*kept, "payload_reject", F.posexplode_outer(pairs).alias("pos", "_pair"))
    reject = F.coalesce("payload_reject", "_pair.reject").alias("payload_reject")
    return rows.select(*kept, reject, "pos", "_pair.job", "_pair.part")


def _payload_reject() -> Column:
    jobs = F.col("_root.jobs")
    name = kind(jobs)
    blank = F.try_variant_get(jobs, "$", "string") == ""
    nothing = (name == "OBJECT<>") | ((name == "STRING") & blank)
    no_list = jobs.isNotNull() & ~F.coalesce(nothing, F.lit(False))
    value = F.col("_body").isNull() & F.col("_texts").isNull() & ~F.startswith(F.ltrim("payload"), F.lit("{"))
    return (
        F.when(F.col("_listed").isNotNull() | F.col("_listed_texts").isNotNull(), F.lit(None).cast("string"))
        .when(value & F.get_json_object("payload", "$").isNotNull(), "body is not an object")
        .when(F.col("_body").isNull() & F.col("_texts").isNull(), "body is not valid JSON")
        .when(F.col("_split").isNotNull(), "body is not valid JSON")
        .when(F.size("_texts") == 1, _member_reject())
        .when(F.col("_more") | F.col("_root").isNull(), "body is not an object")
        .when(no_list, "jobs is not a list")
    )


def _member_reject() -> Column:
    """Why a body that is no variant has no list of jobs, NULL if it is a valid empty body."""
    named = F.array_contains(F.json_object_keys("payload"), "jobs")
    return (
        F.when(F.get("_texts", F.lit(0)).isNull(), "body is not an object")
        .when(F.col("_text").isin("{}", ""), F.lit(None).cast("string"))
        .when(F.col("_text").isNotNull(), "jobs is not a list")
        .when(named.isNull(), "body is not valid JSON")
        .when(named, F.when(F.get_json_object("payload", "$").isNull(), "body is not valid JSON").otherwise("jobs is not a list"))
    )
