"""The corpus pipeline: raw documents to token ids, in five stages.

Every stage works on all that its predecessor kept. The first four return the
columns of ``documents``, others of whatever name included; the last returns ``doc_id``,
the token ids, their number and whether decoding them gives the text back.

Every stage takes an empty table and gives none of its rows; a null text counts as empty;
texts are read whole, however long; columns other than ``doc_id`` and ``text`` may be null
and decide nothing, except that the secret scan sets ``n_chars`` anew where there is one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.llm import byte_bpe, decontam, frames, near_dedup, quality, secrets

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Least similarity, in percent, of near-duplicates.
SIMILARITY = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest.

    Null, empty and short texts go (under 20 words). Each of repeated rows is judged, all
    alike. A row without ``doc_id`` is judged and never learned from. Without labels of both
    kinds the base rules alone decide.
    """
    forest = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(docs, forest).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest ``doc_id``.

    Texts without words are linked with nothing and all stay. Rows that repeat a
    ``doc_id`` are one document, of which one row stays.
    """
    return near_dedup.deduplicated(docs, SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Texts without words stay; each of repeated rows is judged, all alike. Null and blank
    items match nothing.
    """
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; each of repeated rows, and null texts as they are."""
    return secrets.without_secrets(docs)


def byte_bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, each of repeated rows; none for a null or empty text."""
    found = byte_bpe.encoded(docs, TOKENIZER, ["doc_id", "text"])
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return found.select("row.doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == text.cast("binary")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe_encoding", byte_bpe_encoding),
]

#: A forest and BPE merges are no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's table is deleted once its successor is written; the last one stays.
    """
    folder = frames.scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = frames.stored(stage(spark, docs, sf_dir), folder, f"{number}-{name}")
        if before is not None:
            frames.remove(spark, before)
        before = f"{folder}/{number}-{name}"
    return docs
