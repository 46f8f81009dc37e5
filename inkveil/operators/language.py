"""Language of a text by its character trigrams.

A profile lists the most frequent trigrams of a language, best first.  A text is
scored by the ranks of its trigrams (rank-order profiles, Cavnar & Trenkle 1994);
all scores are integers, so results do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.sources.session import materialise

PROFILE_SIZE = 300
MAX_BROADCAST_LANGUAGES = 200
SALTS = 16


def _trigrams(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def profiles(labelled: DataFrame) -> DataFrame:
    """``(lang, gram, weight)`` from ``labelled(text, lang)``; the best gram weighs 300.

    The counts are pre-aggregated per task, so a language may hold any share of
    the texts; the ranking sees one row per distinct gram.
    """
    counts = (
        labelled.select("lang", F.explode(_trigrams(F.col("text"))).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        counts.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= PROFILE_SIZE)
        .select("lang", "gram", (F.lit(PROFILE_SIZE + 1) - F.col("rank")).alias("weight"))
    )


def trained(labelled: DataFrame) -> DataFrame:
    """Profiles computed once and kept as a table of at most 300 rows per language.

    The table is broadcast while it holds no more than 200 languages; with more
    it is joined by shuffle.
    """
    profile = materialise(profiles(labelled), "profiles")
    small = profile.limit(MAX_BROADCAST_LANGUAGES * PROFILE_SIZE + 1).count() <= MAX_BROADCAST_LANGUAGES * PROFILE_SIZE
    return F.broadcast(profile) if small else profile


def scores(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """``(doc_id, page, lang, score)``; partial sums are formed before the shuffle."""
    grams = pages.select("doc_id", "page", F.explode(_trigrams(F.col("text"))).alias("gram"))
    return grams.join(profile, "gram").groupBy("doc_id", "page", "lang").agg(F.sum("weight").alias("score"))


def best_language(scored: DataFrame) -> DataFrame:
    """Highest score wins; on a tie the first code in alphabetical order."""
    order = F.struct((-F.col("score")).alias("s"), F.col("lang").alias("l"))
    return scored.groupBy("doc_id", "page").agg(F.min_by("lang", order).alias("lang"))


def detect_language(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """``(doc_id, page, lang)`` for every page; ``en`` when nothing can be told."""
    grams = pages.select("doc_id", "page", F.explode_outer(_trigrams(F.col("text"))).alias("gram"))
    scored = grams.join(profile, "gram", "left").groupBy("doc_id", "page", "lang").agg(F.sum("weight").alias("score"))
    order = F.when(F.col("lang").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("lang").alias("l")))
    return scored.groupBy("doc_id", "page").agg(F.coalesce(F.min(order)["l"], F.lit("en")).alias("lang"))


def detect_distinct(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """As :func:`detect_language`, computing each distinct text once.

    Worth its shuffle of the texts only where copies are frequent.  Texts are
    told apart by SHA-256; the results are repeated per salt, so a text that
    fills a third of all pages is joined in ``SALTS`` tasks.
    """
    keyed = pages.select("doc_id", "page", "text", F.sha2("text", 256).alias("key"))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    found = best_language(scores(texts.select(F.col("key").alias("doc_id"), F.lit(1).alias("page"), "text"), profile))
    salted = found.select(
        F.col("doc_id").alias("key"), "lang", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    salt = F.pmod(F.hash("doc_id", "page"), F.lit(SALTS))
    return keyed.select("doc_id", "page", "key", salt.alias("salt")).join(salted, ["key", "salt"], "left").select(
        "doc_id", "page", F.coalesce("lang", F.lit("en")).alias("lang")
    )
