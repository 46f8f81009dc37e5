"""Reports: items and totals per document, JSON files, summaries.

A report lists every item of a document in one row per category.  With
``part_pages`` it is cut into parts of that many pages, for documents whose items
do not fit one row; the cut is off unless asked for, so the report of a document
does not change with its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.operators.collate import ORDER, label_of, report_items
from inkveil.sources.session import materialise


def _listed(items: DataFrame, part_pages: int | None) -> DataFrame:
    """``(doc_id, part, category, n, rows, total)``; ``total`` counts the whole document.

    An uncut report has at most one row for each category of a document, whose counts are added where the rows lie.  Items without a document are left out.
    Otherwise totals are repeated per part, so the join is on ``(doc_id, part)`` and a large document stays spread.
    """
    listed = [F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*ORDER, "value"))).alias("rows")]
    if not part_pages:
        lists = items.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "category").agg(*listed)
        return lists.withColumn("part", F.lit(0)).withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    part = F.floor((F.col("page") - 1) / part_pages).cast("int")
    items = materialise(items.withColumn("part", part), "report-items")
    # Dealt by document part, the lists stay where they are for the join.
    lists = items.repartition("doc_id", "part").groupBy("doc_id", "part", "category").agg(*listed)
    per_document = (
        items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.max("part").alias("last"))
        .select("doc_id", "total", F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    )
    return lists.join(per_document, ["doc_id", "part"])


def redaction_report(findings: DataFrame, part_pages: int | None = None) -> DataFrame:
    """``(doc_id, part, category, n_items, total_items_redacted, items)``; items in found order."""
    return _listed(report_items(findings), part_pages).select(
        "doc_id", "part", "category", F.col("n").alias("n_items"),
        F.col("total").alias("total_items_redacted"), F.col("rows.value").alias("items"),
    )


def sensitivity_report(findings: DataFrame, part_pages: int | None = None) -> DataFrame:
    """``(doc_id, part, category, n_findings, total_findings, findings)`` without dedupe.

    ``findings`` is a list of ``(value, page)`` in pattern and page order.
    """
    return _listed(findings.select("doc_id", "category", "value", *ORDER), part_pages).select(
        "doc_id", "part", "category", F.col("n").alias("n_findings"), F.col("total").alias("total_findings"),
        F.transform("rows", lambda r: F.struct(r["value"].alias("value"), r["page"].alias("page"))).alias("findings"),
    )


def report_json(report: DataFrame, items: str, total: str) -> DataFrame:
    """One JSON object per document part from a report table."""
    entry = F.struct(label_of(F.col("category")).alias("k"), F.col(items).alias("v"))
    return report.groupBy("doc_id", "part", total).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(items)
    ).select(
        "doc_id", "part",
        F.to_json(F.struct(F.current_timestamp().alias("timestamp"), "doc_id", "part", total, items)).alias("value"),
    )


def secondary_summary(findings_by_item: DataFrame) -> DataFrame:
    """Totals of the secondary text: each item counts once and adds its values."""
    per_item = findings_by_item.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_values"))
    return per_item.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_images"), F.sum(F.col("n_values") + 1).alias("n_total")
    )


def sensitivity_summary(findings: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """``(category, n_findings)`` over the corpus plus a ``total`` row."""
    counts = findings.groupBy("category").agg(F.count(F.lit(1)).alias("n_findings"), F.count(F.lit(1)).alias("n_total"))
    if secondary is not None:
        images = secondary_summary(secondary).agg(
            F.coalesce(F.sum("n_images"), F.lit(0)).alias("n_findings"),
            F.coalesce(F.sum("n_total"), F.lit(0)).alias("n_total"),
        )
        counts = counts.unionByName(images.withColumn("category", F.lit("images")).filter("n_findings > 0"))
    total = counts.agg(F.coalesce(F.sum("n_total"), F.lit(0)).alias("n_findings"))
    return counts.drop("n_total").unionByName(total.withColumn("category", F.lit("total")))


def recommendation(counts: DataFrame) -> DataFrame:
    """Documents that need redaction, with the categories found (at most ten)."""
    return (
        counts.filter("n_items > 0")
        .groupBy("doc_id")
        .agg(F.sum("n_items").alias("total_items"), F.concat_ws(",", F.array_sort(F.collect_set("category"))).alias("categories"))
    )


def redacted_name(path: Column) -> Column:
    """``<stem>_redacted<suffix>`` in the same folder."""
    with_suffix = F.regexp_replace(path, r"(\.[^./]+)$", "_redacted$1")
    return F.when(path.rlike(r"[^/]\.[^./]+$"), with_suffix).otherwise(F.concat(path, F.lit("_redacted")))


def upload_name(name: Column) -> Column:
    return F.concat(F.lit("redacted_"), name)


def output_check(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Documents whose output is missing or empty: ``(doc_id, problem)``."""
    missing = inputs.select("doc_id").distinct().join(outputs.select("doc_id").distinct(), "doc_id", "left_anti")
    sizes = outputs.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))
    empty = sizes.filter("n = 0").select("doc_id")
    return missing.withColumn("problem", F.lit("missing")).unionByName(empty.withColumn("problem", F.lit("empty")))
