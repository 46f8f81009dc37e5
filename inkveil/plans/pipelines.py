"""Complete jobs put together from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.patterns import profile_patterns
from inkveil.operators import detect, language, mask, report, verify
from inkveil.plans.options import RedactOptions
from inkveil.sources import sinks
from inkveil.sources.session import materialise


def with_language(pages: DataFrame, options: RedactOptions, profile: DataFrame | None = None) -> DataFrame:
    """Pages with the language that heading rules use.

    ``auto`` takes the ``lang`` column when the pages have one, detects with
    ``profile`` when one is given and falls back to English.
    """
    if options.language != "auto":
        return pages.withColumn("lang", F.lit(options.language))
    if "lang" in pages.columns:
        return pages.withColumn("lang", options.page_language(F.col("lang")))
    if profile is None:
        return pages.withColumn("lang", F.lit("en"))
    found = materialise(language.detect_language(pages, profile), "languages")
    return pages.join(found, ["doc_id", "page"])


def find_pages(pages: DataFrame, options: RedactOptions, profile: str = "redact") -> DataFrame:
    return detect.findings(
        pages, profile, options.enabled(), options.mask, preserve_headings=options.preserve_headings
    )


def redact_pages(pages: DataFrame, options: RedactOptions, found: DataFrame | None = None) -> DataFrame:
    """Masked pages; ``found`` reuses findings that are already stored."""
    if found is None:
        found = find_pages(pages, options)
    wanted = mask.targets(found, options.preserve_headings)
    return mask.mask_pages(pages, wanted, options.blur)


def redact_texts(documents: DataFrame, options: RedactOptions, items: bool = False) -> DataFrame:
    return mask.mask_text(documents, options.enabled(), options.mask, items)


def redact_documents(documents: DataFrame, options: RedactOptions) -> DataFrame:
    """The page job on documents stored one per row: no shuffle.

    ``documents(doc_id, text[, lang])``; pages are the lines of ``text``.
    """
    documents = with_language(documents, options)
    return mask.mask_documents(
        documents, options.enabled(), options.mask, options.preserve_headings, options.blur
    )


@dataclass(frozen=True)
class RedactionRun:
    findings: DataFrame
    masked: DataFrame | None
    report: DataFrame
    issues: DataFrame | None
    summary: DataFrame | None


def run_page_job(pages: DataFrame, options: RedactOptions, out_dir: str, profile: DataFrame | None = None) -> RedactionRun:
    """Find, mask, write, report and verify; every step is a stored table.

    The texts are scanned once for findings, read once for masking and twice
    (masked) for the two kinds of verification; a language that must be detected
    is stored once and joined for masking only.  Each step reads the stored result of the former
    one, so an executor that is lost repeats single tasks and not the scan.
    """
    kind = "scan" if options.report_only else "redact"
    found = sinks.write_table(find_pages(pages, options, kind), f"{out_dir}/findings")
    if options.report_only:
        rows = report.sensitivity_report(found)
        sinks.write_sensitivity_report(rows, f"{out_dir}/sensitivity_report")
        return RedactionRun(found, None, rows, None, None)
    masked = sinks.write_table(redact_pages(with_language(pages, options, profile), options, found), f"{out_dir}/masked")
    rows = report.redaction_report(found)
    sinks.write_redaction_report(rows, f"{out_dir}/redaction_report")
    issues = summary = None
    if options.verify:
        patterns = profile_patterns("redact", options.enabled(), options.mask)
        issues = sinks.write_table(
            verify.leftover_matches(masked, patterns)
            .withColumnRenamed("match_no", "no")
            .unionByName(
                verify.leftover_words(masked, patterns).withColumnRenamed("word_no", "no"), allowMissingColumns=True
            ),
            f"{out_dir}/issues",
        )
        summary = verify.summary(pages.select("doc_id").distinct(), issues)
        sinks.write_table(summary, f"{out_dir}/verification")
    return RedactionRun(found, masked, rows, issues, summary)

