"""Corpus preparation in five stages, each a function of (spark, docs, sf_dir) over all rows it is given.

language     keeps documents whose language is determined with a calibrated score of 0.5 or more
near_dedup   keeps one document, that with the smallest doc_id, of each group linked by five-word shingles at 0.8
decontaminate  drops documents that hold a passage of a benchmark item, exact or edited
secrets      replaces each secret in the text, keeping the document
bpe          encodes the texts and decodes them again: counts and digests

The first four return the columns of documents.  A stage's rows are written as Parquet and read
again as the next one's.  Null texts go in the first stage, as they have no language; null doc_ids
are kept; repeated rows are the same document and stay repeated, and so are two texts of one doc_id,
which stay or go together; very long texts pass whole; extra columns stay as they are up to the last
stage, with dots, spaces or signs in their names (names that differ from others by case alone need a
case-sensitive session, as anywhere in Spark); empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm.bpe import round_trip_digests
from packwright.llm.decontaminate import clean_documents
from packwright.llm.files import stored
from packwright.llm.language_id import confident, learn, training_rows
from packwright.llm.near_dedup import Near, near_duplicates
from packwright.llm.queries import table, vocabulary_path
from packwright.llm.secret_scan import redacted


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return confident(docs, learn(docs.where(training_rows(docs))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_duplicates(docs, Near(words=5, percent=80))
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")  # no column is named but these


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip_digests(docs, vocabulary_path())


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("bpe", bpe)]

#: The stages learn models and link documents; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
