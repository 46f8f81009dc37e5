"""Sinks: masked pages, findings and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkveil.operators.report import report_json


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as parquet and return the stored table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(df: DataFrame, path: str) -> None:
    """Masked texts as one line-delimited JSON object per page (texts may hold line ends)."""
    df.select("doc_id", "page", "text").write.mode("overwrite").json(path)


def write_redaction_report(report: DataFrame, path: str) -> None:
    report_json(report.withColumnRenamed("items", "redacted_items"), "redacted_items", "total_items_redacted").select(
        "value"
    ).write.mode("overwrite").text(path)


def write_sensitivity_report(report: DataFrame, path: str) -> None:
    report_json(report, "findings", "total_findings").select("value").write.mode("overwrite").text(path)
