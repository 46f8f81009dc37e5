"""Corpus pipeline: documents to packed bins.  Each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import decontam, langid, packing, secrets, simhash
from inkveil.llm.common import table, wrapped
from inkveil.sources.session import shared_dir

#: Texts that look like none of the learned languages score below this (a one-versus-rest output, 1 for a sure case).
LEAST_LANGUAGE_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; no text, no letter or no likeness to any of them: out.

    A text of some dozen letters is too short for a likeness and stays if its score does; so do all with fewer than
    ``langid.LEAST_ROWS`` labelled rows.
    """
    rows = langid.predict(wrapped(docs, "text"), langid.train(docs.select("doc_id", "text", "lang")), judge=True)
    known = (F.col("_language.lang_pred") != langid.UND) & (F.col("_language.score") >= LEAST_LANGUAGE_SCORE) & F.col("_language.like")
    return rows.where(known).select("_row.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: fingerprints of three-word shingles, linked at two or fewer differing bits."""
    return simhash.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return secrets.mask_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no expression for the trained model, the near copies and the packing; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
