"""Per-document views of findings: first-seen values, order, counts.

Groups are pre-aggregated before any shuffle, and no document is gathered into
one row or one task, so a document may hold any share of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.patterns import CATEGORY_LABEL, REPEATED_CATEGORIES
from inkveil.sources.session import materialise

ORDER = ["cat_no", "ordinal", "page", "match_no"]
PAGE_RANGE = 1024


def first_seen(findings: DataFrame) -> DataFrame:
    """Each value once per document and category, with its first position and count."""
    position = F.struct(*ORDER)
    return (
        findings.groupBy("doc_id", "category", "value")
        .agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("n"))
        .select("doc_id", "category", "value", "first.*", "n")
    )


def report_items(findings: DataFrame) -> DataFrame:
    """Items as reported: one per value, or one per occurrence for e-mail and masks."""
    position = F.struct(*ORDER)
    occurrence = F.when(F.col("category").isin(REPEATED_CATEGORIES), position)
    return (
        findings.withColumn("_occurrence", occurrence)
        .groupBy("doc_id", "category", "value", "_occurrence")
        .agg(F.min(position).alias("first"))
        .select("doc_id", "category", "value", "first.*")
    )


def category_counts(findings: DataFrame) -> DataFrame:
    """``(doc_id, category, n_items)`` after the category's own dedupe rule."""
    weight = F.when(F.col("category").isin(REPEATED_CATEGORIES), F.col("n")).otherwise(F.lit(1))
    once = findings.groupBy("doc_id", "category", "value").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("doc_id", "category").agg(F.sum(weight).alias("n_items"))


def merged_counts(values: DataFrame) -> DataFrame:
    """:func:`category_counts` from values ``(doc_id, category, value, n)`` that were first seen in several parts."""
    weight = F.when(F.col("category").isin(REPEATED_CATEGORIES), F.col("n")).otherwise(F.lit(1))
    once = values.groupBy("doc_id", "category", "value").agg(F.sum("n").alias("n"))
    return once.groupBy("doc_id", "category").agg(F.sum(weight).alias("n_items"))


def totals(counts: DataFrame) -> DataFrame:
    """Totals per document, per category and overall in one pass."""
    return (
        counts.groupingSets([["doc_id"], ["category"], []], "doc_id", "category")
        .agg(F.sum("n_items").alias("total_items"))
        .select("doc_id", "category", "total_items")
    )


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """1-based position within ``group`` by ``order``, without one task per group.

    ``order`` contains ``page``.  Rows are numbered inside ranges of pages, and a
    running sum over the row counts of the ranges gives each range its offset.
    ``rows`` is read twice and therefore stored.
    """
    rows = materialise(rows, "ranked")
    lead = order[: order.index("page")]
    ranges = rows.withColumn("_range", F.floor(F.col("page") / PAGE_RANGE))
    keys = [*group, *lead, "_range"]
    by_range = Window.partitionBy(*group).orderBy(*lead, "_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(by_range), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        ranges.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_range", "_offset", "_inside")
    )


def zero_filled(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """Every document with all ten categories, zero where nothing was found.

    ``counts(doc_id, category, n_items)`` has a row for each category of a document; they become one row, joined by document.
    """
    wide = counts.groupBy("doc_id").agg(*[F.sum(F.when(F.col("category") == k, F.col("n_items"))).alias(f"_{k}") for k in CATEGORY_LABEL])
    labels = F.array(*[
        F.struct(F.lit(k).alias("category"), F.lit(v).alias("label"), F.coalesce(F.col(f"_{k}"), F.lit(0)).alias("n_items")) for k, v in CATEGORY_LABEL.items()
    ])
    return documents.select("doc_id").join(wide, "doc_id", "left").select("doc_id", F.inline(labels))


def found_phrase(counts: DataFrame) -> DataFrame:
    """``(doc_id, total_items, phrase)`` for documents with findings.

    A document has at most ten categories, so the collected list is bounded.
    """
    text = F.concat(F.col("n_items").cast("string"), F.lit(" "), F.lower(label_of(F.col("category"))))
    return (
        counts.filter("n_items > 0")
        .groupBy("doc_id")
        .agg(F.sum("n_items").alias("total_items"), F.array_sort(F.collect_list(F.struct(F.col("category"), text.alias("t")))).alias("parts"))
        .select("doc_id", "total_items", F.concat_ws(", ", F.col("parts.t")).alias("phrase"))
    )


def first_category(findings: DataFrame) -> DataFrame:
    """First category, in processing order, found in each document."""
    return findings.groupBy("doc_id").agg(F.min_by("category", "cat_no").alias("category"))


def label_of(category: Column) -> Column:
    return F.element_at(
        F.create_map(*[x for k, v in CATEGORY_LABEL.items() for x in (F.lit(k), F.lit(v))]), category
    )
