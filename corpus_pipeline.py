"""Training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again for the next.

``run`` returns the last stage: the documents that stay, sanitised, with their
pieces.  Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seasoncast.llm.edit_decontam import WHOLE, decontaminate
from seasoncast.llm.line_quality import clean_documents
from seasoncast.llm.lsh_forest_join import one_of_each
from seasoncast.llm.pii_disclosure import sanitise_documents
from seasoncast.llm.piece_nbest import encode_documents
from seasoncast.session import materialise
from seasoncast.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much or fail the document rules."""
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word-shingle similarity 0.8 stays, the one with the least doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), WHOLE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced or taken out of the texts."""
    return sanitise_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their best segmentation and the log-scores of the n best."""
    return encode_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("pieces", pieces)]

ORACLE_SQL = None  # the stages are beyond SQL; tests/llm/test_pipeline.py holds them against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
