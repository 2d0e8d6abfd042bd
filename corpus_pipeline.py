"""A training-corpus pipeline over ``documents``, of operators of ``tessella.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs``, which the stage before has
written as Parquet, and returns a DataFrame; all but the last keep the columns of ``documents``.

In every stage a null text counts as empty, null values in other columns pass as they are, and an
empty table gives an empty table. Rows that repeat an id and a text are one document from the
second stage on; a row without id is a document of its own, and stays last among equal texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import byte_bpe, byte_cnn, exact_dedup, jaccard_join, mixing
from tessella.llm.shared import importable, keep, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, fitted on the labelled rows of ``documents``,
    accepts."""
    importable(spark)
    return byte_cnn.drop_rejected(docs, byte_cnn.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the one with the smallest doc_id."""
    importable(spark)
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts, the one with the smallest doc_id."""
    importable(spark)
    return jaccard_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights; a document is there once per epoch that takes
    words of it, with the words taken."""
    importable(spark)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    importable(spark)
    return byte_bpe.bpe_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("exact dedup", without_exact_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed),
    ("byte-level BPE", encoded),
]

#: A network's weights and hashed permutations have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs, f"stage-{number}")
    return docs
