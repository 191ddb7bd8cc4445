"""Corpus pipeline: language ID, near-dedup, decontamination, secret scan, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, langid, pieces, secrets, simhash
from lectern.llm.common import release, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one of the languages that the labels name; texts unlike all of them, null and empty texts and texts without a letter go.

    Every row is judged by its own text, so repeats go or stay alike. Without labels, all texts with a letter stay.
    """
    return langid.known_language(docs, langid.trained(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the least doc_id; null and empty texts are copies.

    Rows that repeat that doc_id stay together. Five-word shingles, a similarity of 0.8 or more.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows don't contaminate; null and empty texts stay, and so do all where the benchmark is empty."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars set anew; null and empty texts stay as they are."""
    return secrets.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the ids of their pieces; a null or empty text has none. Columns named like the new ones are an error."""
    return pieces.encode(docs, pieces.vocabulary())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: Language ID, SimHash and the forest can't be written in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder before the next one reads it.

    What a stage wrote is removed once the next one is written; what the last one reads stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            release(before)
            before = docs
    return docs
