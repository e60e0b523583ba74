"""The corpus pipeline: five stages from raw documents to packed sequences.

Quality rules drop documents, of near duplicates one stays, secrets are masked,
sources are mixed to their target weights, and what is left is packed. Each
stage works on all rows of the one before it, written as Parquet in between.

Defined cases, by stage: a document with a null or empty text, or of fewer than ten
words, fails the base rules and goes at once; of rows equal in doc_id and text one
stays, the least in all columns, and of a group of near copies the one with the
least doc_id, null last; texts of any length are searched and packed whole; a null
source is a source of its own, the last; a null doc_id stays null; an empty table
gives an empty result. All columns of documents pass to the last stage, also those
whose names an operator uses itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ancestra.llm import jaccard, mixing, packing, quality, secrets
from ancestra.llm.storage import documents, new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior quality is good."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("packing", packing_stage),
]

#: Tokenizers, expectation-maximisation and guess costs are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = new_path(spark, name)
            docs.write.parquet(folder)
            docs = spark.read.schema(docs.schema).parquet(folder)
    return docs
