"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Stages take ``(spark, docs, sf_dir)``. All but the last return the columns of
``documents``; those that change texts set ``n_chars`` anew where there is such a
column. Null texts: the first stage rejects them with all texts that have no
letter. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodemand.llm.common import prepare, shared_folder
from geodemand.llm.decontaminate import remove_contamination
from geodemand.llm.langid import keep_identified, learn_languages, training_rows
from geodemand.llm.packing import pack_documents
from geodemand.llm.secrets import redact_secrets
from geodemand.llm.simhash import drop_near_copies


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language (operator 4, learned from the labelled rows of ``docs``)."""
    return keep_identified(docs, learn_languages(training_rows(docs)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group of near copies (operator 6)."""
    return drop_near_copies(docs, 3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``benchmark`` (operator 5)."""
    return _measured(remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the literals of secrets masked (operator 9)."""
    return _measured(redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids (operator 3)."""
    return pack_documents(docs, 2048)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", decontaminate),
    ("secret scans", hide_secrets),
    ("packing", pack),
]

#: The stages cannot be written in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the result is read from the last stage's files."""
    prepare(spark)
    folder = shared_folder(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
