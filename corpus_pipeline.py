"""A training corpus from raw documents: identify languages, drop near-duplicates, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents.

Nulls, empty texts and repeats: a text without words is no language and goes in the first stage; of rows with equal key
and text one stays in the second; a null source is a source, a null key a key; a null text is one token long. Other
columns stay with their rows. An empty table gives no rows in any stage. ``n_chars`` is needed by the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rundiff.llm import language, mixing, ngram_join, pii, seq_packing
from rundiff.llm.queries import tokenizer_path
from rundiff.llm.tables import free_prefix, only, table
from rundiff.session import cut_lineage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return language.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links."""
    return ngram_join.keep_one_of_each(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted again where that changed a text."""
    before = f"{free_prefix(docs)}length"
    clean = pii.redact_pii(docs.withColumn(before, F.length("text")))
    changed = F.length("text") != F.col(before)
    return only(clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return seq_packing.pack_documents(docs, tokenizer_path())


STAGES = [("language", identified), ("near_duplicates", distinct), ("personal_data", redacted), ("mix", mixed), ("pack", packed)]

# Tokens, inferred languages and bootstrapped contexts have no SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
