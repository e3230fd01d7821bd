"""From raw documents to packed training sequences: rules, near-duplicates, secrets, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellsift.llm import mixing, neardup, packing, quality, secrets
from cellsift.llm.base import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rules nor those with risk-controlled cutoffs reject.

    Null and empty texts and those of fewer than 50 words fail the base rules. Repeated rows are judged each
    for itself, null ids too. All columns stay as they are, whatever their names. No rows give none.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class of near-duplicates.

    Rows with null or equal ids and different texts are different documents. Repeated rows become one. All
    columns stay as they are, whatever their names. No rows give none.
    """
    return neardup.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by the name of its kind; n_chars follows the new text.

    A row for each row, null texts stay null. All other columns stay as they are, whatever their names.
    """
    return secrets.redact(docs)


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' rates draw them, in one global order.

    Rows with equal ids are drawn equally often, null ids by their texts; a null source is a source. All
    columns stay as they are, whatever their names. No rows give none.
    """
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces' places in sequences of 2,048 tokens.

    Every row is packed for itself, repeated ones and null ids too; a null or empty text is one piece, the end
    token. Longer documents are cut. Extra columns are ignored. No rows give none.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("target_mixture", target_mixture),
    ("packed_sequences", packed_sequences),
]

#: Near-duplicate classes, automata and byte-level tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
