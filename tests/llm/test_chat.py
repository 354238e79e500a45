"""Chat texts: what is read back is what went in, and nothing leaves the JVM."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sift.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, loss int"
TEXTS = [
    "", None, "plain", "a\\b", "\\\\", "<|im_end|>\n", "<|im_start|>user\nhi<|im_turn|>", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>",
    "<", "|", "<\\|", "[", "é😀<|", "line\nline\n", "<|im_turn|", "\\<|",
]
ROLES = ["user", "assistant", "system", "assistant", None, "tool <|im_end|>\n"]


def read_back(found):
    found = found.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss")))
    return {r.conv_id: r for r in found.collect()}


def test_round_trip_with_merged_turns_and_control_strings(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(ROLES), rng.choice(TEXTS), "x", 1) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(60, t, "assistant" if t % 3 else "user", f"t{t}" * (t % 5), "x", 1) for t in range(500)]
    rng.shuffle(rows)
    found = read_back(chat.chat_texts(spark.createDataFrame(rows, SCHEMA)))
    assert len(found) == 61
    for conv, row in found.items():
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert [(t.role, t.text) for t in row.turns] == own
        assert row.learned == [text for role, text in own if role == "assistant"]
        runs = 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:]))
        assert row.formatted.count(chat.START) == row.formatted.count(chat.END) == runs


def test_ties_missing_values_and_no_rows(spark):
    rows = [(1, 0, "user", "b", None, None), (1, 0, "user", "a", None, None), (1, 0, "user", "a", None, None), (None, None, None, None, None, None), (1, None, "system", "s", None, None)]
    found = read_back(chat.chat_texts(spark.createDataFrame(rows, SCHEMA)))
    assert [(t.role, t.text) for t in found[1].turns] == [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [(t.role, t.text) for t in found[None].turns] == [("", "")]
    assert chat.chat_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_expressions_only(spark):
    found = chat.chat_texts(spark.createDataFrame([], SCHEMA))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
