"""Language lookups: pattern sets and heading rules with fallback to English.

All dimensions are built from constants and hold fewer than a hundred rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.headings import HEADING_WORDS, LABEL_HEADINGS
from inkveil.functions.patterns import LANG


def pattern_dimension(spark: SparkSession) -> DataFrame:
    rows = [
        (lang, category, i, regex)
        for lang, cells in LANG.items()
        for category, regexes in cells.items()
        for i, regex in enumerate(regexes, 1)
    ]
    return spark.createDataFrame(rows, "set_lang string, category string, ordinal int, regex string")


def pattern_sets(documents: DataFrame) -> DataFrame:
    """Patterns that apply to each document ``(doc_id, lang)``.

    The fallback is per language: a known language without a category has no
    pattern for it.
    """
    known = F.when(F.col("lang").isin(list(LANG)), F.col("lang")).otherwise("en")
    dim = F.broadcast(pattern_dimension(documents.sparkSession))
    return documents.withColumn("set_lang", known).join(dim, "set_lang")


def heading_sets(documents: DataFrame) -> DataFrame:
    """Label and word rules that apply to each document; both fall back on their own."""
    spark = documents.sparkSession
    labels = spark.createDataFrame([(k, k) for k in LABEL_HEADINGS], "lang string, label_lang string")
    words = spark.createDataFrame([(k, k, len(w)) for k, w in HEADING_WORDS.items()], "lang string, word_lang string, n int")
    joined = documents.join(F.broadcast(labels), "lang", "left").join(F.broadcast(words), "lang", "left")
    return joined.select(
        "doc_id", "lang", F.coalesce("label_lang", F.lit("en")).alias("label_lang"),
        F.coalesce("word_lang", F.lit("en")).alias("word_lang"), F.coalesce("n", F.lit(len(HEADING_WORDS["en"]))).alias("n_words"),
    )
