"""From documents to packed training sequences: toxicity, near-duplicates, repeated passages,
secrets, packing. Each stage's table is written and read again as the next one's input.

All stages take texts whole, of any length, treat a null text as empty (and keep it
null), keep every row they don't reject, also repeated ones and those without a
doc_id, and return no rows for no rows. All but the last return the columns of
``documents``, whatever these are."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plexa.llm import neardup, packing, secrets, substrings, toxicity
from plexa.llm.text import stored


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. Empty and null texts are judged by the
    intercept alone; without labels of both kinds every document has the rate of label 1. Equal
    rows get equal verdicts."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of least doc_id, with all its rows. Documents
    without words are classes of their own; rows without a doc_id stay."""
    return neardup.dedup(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of 50 words that start in a document of smaller doc_id;
    n_chars follows. Rows of one doc_id don't make each other shorter; rows without a doc_id stay
    as they are. A text may end up empty."""
    return substrings.dedup(docs)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by the kind's name; n_chars follows. Of spans that overlap the
    first names them all."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in the training sequences. Every row is a document; null
    and empty texts are a lone end token."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_copies_out),
    ("substring_dedup", repeats_out),
    ("secrets", secrets_out),
    ("packing", packed),
]

#: SQL can't express a trained classifier, sketches or the packing search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
