r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of
one role share a header. The template is

    <|im_start|>ROLE \n TEXT <|im_turn|> TEXT <|im_end|> \n

with a text for every turn, so single turns can be read back. In texts a backslash
is doubled, and one is put behind the first character of every control string, of
this template or of other usual ones; dropping one backslash before each character
that follows one gives the text back. Roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|im_turn|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
#: Control strings: those of this template and what other templates mark turns with.
CONTROL = r"([<\[])(\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _running(values: Column) -> Column:
    """The sum of all values before each."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    return F.aggregate(values, start, step, lambda a: a["out"])


def prefix_sums(values: Column) -> Column:
    """``_running`` in chunks of about the root of the length, as appending copies an array."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values)), step)
    chunks = F.transform(at, lambda s: F.slice(values, s, step))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return F.flatten(F.zip_with(chunks, _running(totals), lambda c, base: F.transform(_running(c), lambda v: v + base)))


def chat_texts(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss`` of every conversation (rows ``conv_id, turn, role, text``).

    ``loss`` is an array of ``start, end``: the places, in code points of ``formatted``,
    of the assistant's texts. Null text or role counts as empty. Turns sort by number, a
    null first; rows with equal numbers sort by role, then text, and repeated rows all
    stay. Rows without ``conv_id`` are one conversation. Other columns are ignored, and
    an empty table gives no rows. A conversation is one row of the result, so it must
    fit into one, which no other way of formatting it would change.
    """
    rows = conversations.select(
        "conv_id", "turn", F.url_encode(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        (F.coalesce(F.col("role").cast("string"), F.lit("")) == LOSS_ROLE).alias("learned"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "learned"))).alias("turns")
    grouped = rows.groupBy("conv_id").agg(turns)
    role = F.transform("turns", lambda t: t["role"])
    nothing = F.array(F.lit(None).cast("string"))
    grouped = grouped.withColumn("prior", F.concat(nothing, F.slice(role, 1, F.size(role) - 1)))
    grouped = grouped.withColumn("next", F.concat(F.slice(role, 2, F.size(role)), nothing))
    # Adjacent turns of one role are merged: a header before the first, an end after the last.
    merged = F.zip_with("turns", "prior", lambda t, p: F.struct(
        t["text"].alias("text"), t["role"].alias("role"), t["learned"].alias("learned"),
        F.when(p.isNotNull() & (p == t["role"]), F.lit(TURN)).otherwise(F.concat(F.lit(START), t["role"], F.lit("\n"))).alias("head"),
    ))
    pieces = F.zip_with(merged, "next", lambda t, n: F.struct(
        t["head"].alias("head"), t["text"].alias("text"), t["learned"].alias("learned"),
        F.when(n.isNotNull() & (n == t["role"]), F.lit("")).otherwise(F.lit(END)).alias("tail"),
    ))
    grouped = grouped.select("conv_id", pieces.alias("pieces"))
    whole = lambda p: F.concat(p["head"], p["text"], p["tail"])
    grouped = grouped.select("conv_id", "pieces", F.transform("pieces", lambda p: F.length(whole(p)).cast("bigint")).alias("sizes"))
    grouped = grouped.select("conv_id", "pieces", prefix_sums(F.col("sizes")).alias("starts"))
    spans = F.zip_with("pieces", "starts", lambda p, s: F.struct(
        (s + F.length(p["head"])).alias("start"), (s + F.length(p["head"]) + F.length(p["text"])).alias("end"), p["learned"].alias("learned"),
    ))
    loss = F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return grouped.select("conv_id", F.array_join(F.transform("pieces", whole), "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text: an array of ``role, text``."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    head = rf"(?s)^<\|im_start\|>([^\n]*)\n(.*)$"

    def turns(block: Column) -> Column:
        role = F.url_decode(F.regexp_extract(block, head, 1))
        texts = F.split(F.regexp_extract(block, head, 2), r"<\|im_turn\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
