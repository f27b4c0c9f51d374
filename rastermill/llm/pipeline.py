"""The corpus pipeline: rule out bad documents, keep one of each near-duplicate class, redact secrets, mix, encode.

Each stage takes the rows that its predecessor kept, with the columns of `documents`, and all but the last return these
columns, whatever others there are. Null text counts as empty and is ruled out by the first stage, as are all texts of
fewer than 50 words; long texts are taken whole; repeated rows become one in the second stage; an empty table gives an
empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, mixing, near_dedup, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the line field, which is fitted on these documents' labels. Null and empty texts go;
    repeated rows stay or go together.
    """
    return quality.keep_good(docs, quality.train(docs, common.read(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; of repeated rows one, and of texts without words one."""
    return near_dedup.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never; those without words as their hash says."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; null and empty texts have none."""
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup_stage),
    ("secret scan", secret_scan),
    ("mix sources", mix_sources),
    ("encode", encode),
]

#: The line field, the Markov models and BPE have no counterpart in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: one row for each time the mix takes a document, with its token ids.

    Each stage's rows are written as Parquet to the shared folder and read again by the next; a stage's table is deleted
    once the next one is written. The last one stays, since the result is read from it.
    """
    docs = common.read(spark, sf_dir, "documents")
    where = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
        if k:
            common.remove(spark, f"{where}/{k - 1}")
    return docs
