"""The corpus pipeline: stages that each keep, change or lay out documents, written and read again between stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veridex.llm import line_dedup, ngram_join, packing, pii, quality
from veridex.llm.common import bound_batches, stage, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject as low in quality or toxic.

    Null texts, hosts and paths are judged like others, repeated rows alike; all columns stay, whatever their names.
    """
    bound_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated line runs.

    Null texts stay null; a text that loses every line is empty; rows equal in doc_id and text change alike.
    """
    return line_dedup.without_repeated_runs(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the least doc_id, of each group of equal or similar ones.

    Rows without words are in no group and stay, as does an unrelated text under a doc_id that occurs twice.
    """
    bound_batches(spark)
    return ngram_join.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, with personal data in text replaced by their kind; null texts stay null."""
    bound_batches(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences; a null or empty text is its end id alone."""
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", delete_repeated_lines),
    ("near_copies", keep_one_of_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: The last stage packs token ids, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
