"""Corpus pipeline: toxicity filter, exact dedup, near-duplicate dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's documents.  All but the last return the columns of ``documents``.  Rows with null ids or texts go through
every stage by the rules of its operator; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from tessera.llm.common import crc_mod, read_table, written
from tessera.llm.queries import WORD_VOCAB

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learned from the labelled ones not held out, doesn't reject."""
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic").filter(crc_mod(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    return toxicity.drop_toxic(docs.select(*COLUMNS), model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased) the one with the largest id."""
    return exact_dedup.keep_first(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id."""
    return near_dedup.keep_representatives(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and ``n_chars`` counted anew."""
    clean = secrets.redact_secrets(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 tokens, with their ids."""
    return packing.pack(docs, WORD_VOCAB)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_tokens),
]

# No stage but the exact dedup can be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
