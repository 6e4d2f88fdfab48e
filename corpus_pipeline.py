"""Cleaning of a corpus in stages: each takes what its predecessor kept, as a table with the columns of documents.

1. The quality scorer (trained on weak labels of the stage's own input) drops what it rejects.
2. Of texts that are equal but for white space one stays.
3. Of each class of near-duplicates (five-word shingles, similarity 0.8) the document with the least ``doc_id`` stays.
4. Documents that hold a benchmark item are dropped.
5. The rest is encoded; the result has ``doc_id``, ``lang``, ``source``, ``n_tokens``, ``token_ids`` and ``decoded``.

A null text counts as empty. Rows may repeat and ``doc_id`` may be null: exact copies are told apart by row, and a
document without words is a class of its own. Extra columns are kept but for the last stage. Empty tables give empty
results, an empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dyadspark.llm import bpe, chosen_path, chunk_recipes, decontamination, weak_labels
from dyadspark.llm.common import table
from dyadspark.llm.queries import word_vocabulary
from dyadspark.session import stored


def prose(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_labels.prose_only(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunk_recipes.without_copies(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.one_per_class(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_only(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = bpe.encode(docs.select("doc_id", "lang", "source", "text"), word_vocabulary())
    return kept.select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded")


STAGES = [
    ("quality classifier", prose),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", different),
    ("benchmark decontamination", unleaked),
    ("BPE encoding and decoding", encoded),
]

ORACLE_SQL = None  # the stages cannot be said in SQL; tests/llm compares them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
