"""Every operator as a runnable query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions import headings, validators
from inkveil.functions.patterns import (
    SECONDARY_FLAG, SECONDARY_GROUPS, SECONDARY_MINIMAL, category_patterns, profile_patterns,
)
from inkveil.operators import collate, detect, international, language, lookup, mask, report, verify
from inkveil.plans.options import RedactOptions, accepted_language
from inkveil.plans.pipelines import redact_documents, redact_pages, run_page_job
from inkveil.sources import corpus, document_files
from inkveil.sources.session import shared_dir
from inkveil.streaming import generations, page_stream, redact_stream

Query = Callable[[SparkSession, str], DataFrame]
MASK = "the"
MASK_REGEX = r"\bth[a-z]+tion\b"
WORD_REGEX = r"\b[a-z]+tion\b"
QUERIES: dict[str, Query] = {}


ALL = RedactOptions(all_categories=True)


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def _redact(spark, sf, **kw):
    return detect.findings(corpus.corpus_pages(spark, sf), "redact", **kw)


# ------------------------------------------------- sources and sinks -------
@query("page_scan")
def page_scan(spark, sf):
    return corpus.document_pages(spark, sf).select("doc_id", "page", "text")


@query("text_decode")
def text_decode(spark, sf):
    """Documents in eight forms of bytes: with and without a byte-order mark, in both byte orders, cut, and with other line ends."""
    docs = corpus.table(spark, sf, "documents").select("doc_id", "text")
    text, form = F.col("text"), F.when(F.col("text").rlike(r"^[\x00-\xFF]*$"), F.col("doc_id") % 8).otherwise(0)
    mark = lambda code: F.unhex(F.lit(code))
    content = (
        F.when(form == 1, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE"))).when(form == 2, F.encode(text, "UTF-16LE")).when(form == 3, F.encode(text, "UTF-16BE"))
        .when(form == 4, F.encode(text, "ISO-8859-1")).when(form == 5, F.encode(F.replace(text, F.lit("\n"), F.lit("\r\n")), "UTF-8"))
        .when(form == 6, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE"))).when(form == 7, F.concat(F.encode(text, "UTF-16LE"), mark("21")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return docs.select("doc_id", corpus.decoded(content).alias("d")).select("doc_id", "d.codec", "d.text")


def _files(spark, sf):
    name = F.concat(
        F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 4 == 0, ".txt").when(F.col("doc_id") % 4 == 1, ".TXT")
        .when(F.col("doc_id") % 4 == 2, ".pdf").otherwise(".PDF"),
    )
    return corpus.table(spark, sf, "documents").select("doc_id", name.alias("path"), "n_chars")


@query("route_by_suffix")
def route_by_suffix(spark, sf):
    return _files(spark, sf).select("doc_id", "path", corpus.route(F.col("path")).alias("route"))


@query("admission_filter")
def admission_filter(spark, sf):
    name = F.when(F.col("doc_id") % 7 != 0, F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("path")))
    files = _files(spark, sf).select("doc_id", name.alias("name"), (F.col("n_chars") * 10000).alias("size"))
    return files.select("doc_id", "name", "size", corpus.reject_reason(F.col("name"), F.col("size")).alias("reject_reason"))


@query("redacted_sink")
def redacted_sink(spark, sf):
    path = shared_dir(spark, "redacted")
    masked = mask.mask_text(corpus.whole_documents(spark, sf).select("doc_id", "text"), mask=MASK)
    masked.write.parquet(path)
    stored = spark.read.schema(masked.schema).parquet(path)
    named = _files(spark, sf).select(
        "doc_id", report.redacted_name(F.col("path")).alias("out_path"),
        report.upload_name(F.regexp_extract("path", "[^/]+$", 0)).alias("upload_name"),
    )
    return stored.join(named, "doc_id").select("doc_id", "out_path", "upload_name", "text")


@query("redacted_files")
def redacted_files(spark, sf):
    """Masked documents written as one file each, and read back."""
    path = shared_dir(spark, "redacted-files")
    pages = corpus.document_pages(spark, sf)
    document_files.write_masked_files(redact_pages(pages, ALL), _files(spark, sf).select("doc_id", "path"), path)
    return document_files.read_files(spark, path)


@query("report_files")
def report_files(spark, sf):
    """One JSON report a document, read back; a document without findings has a report without categories."""
    path = shared_dir(spark, "report-files")
    found = detect.findings(corpus.document_pages(spark, sf), "redact")
    document_files.write_report_files(found, _files(spark, sf).select("doc_id", "path"), path)
    schema = "input_file string, output_file string, total_items_redacted bigint, redacted_items map<string,array<string>>"
    rows = document_files.read_files(spark, path).select("name", F.from_json("text", schema).alias("r")).select("name", "r.*")
    rows = rows.select("*", F.explode_outer("redacted_items").alias("category", "found"))
    return rows.select("name", "input_file", "output_file", "total_items_redacted", "category", F.array_join("found", "|").alias("items"))


@query("output_files_check")
def output_files_check(spark, sf):
    """Problems of files that were written for nine of ten documents, some of them empty."""
    path, names = shared_dir(spark, "checked-files"), _files(spark, sf).select("doc_id", "path")
    text = F.when(F.col("doc_id") % 10 == 4, "").otherwise(F.col("text"))
    pages = corpus.whole_documents(spark, sf).where("doc_id % 10 <> 3").select("doc_id", F.lit(1).alias("page"), text.alias("text"))
    document_files.write_masked_files(pages, names, path)
    return document_files.check_files(names, path)


def _listed(name: str):
    return F.array_join(name, "|").alias("items")


@query("redaction_report")
def redaction_report(spark, sf):
    rows = report.redaction_report(_redact(spark, sf))
    return rows.select("doc_id", "part", "category", "n_items", "total_items_redacted", _listed("items"))


@query("sensitivity_report")
def sensitivity_report(spark, sf):
    rows = report.sensitivity_report(detect.findings(corpus.corpus_pages(spark, sf), "scan"))
    flat = F.transform("findings", lambda f: F.concat(f["value"], F.lit("@"), f["page"].cast("string")))
    return rows.select("doc_id", "part", "category", "n_findings", "total_findings", F.array_join(flat, "|").alias("items"))


@query("output_check")
def output_check(spark, sf):
    docs = corpus.whole_documents(spark, sf).select("doc_id", "text")
    kept = mask.mask_text(docs).filter(F.col("doc_id") % 10 != 3)
    outputs = kept.withColumn("text", F.when(F.col("doc_id") % 10 == 4, "").otherwise(F.col("text")))
    return report.output_check(docs, outputs)


# --------------------------------------- options, projections, filters -----
SELECTIONS = {
    "all": RedactOptions(all_categories=True),
    "mail_and_cards": RedactOptions(categories=("credit_card", "email")),
    "mask_only": RedactOptions(mask=MASK),
}


@query("category_select")
def category_select(spark, sf):
    """One scan with all patterns; each selection then takes its categories."""
    found = detect.find(corpus.corpus_pages(spark, sf), profile_patterns("redact", mask=MASK))
    counts = found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    chosen = F.array_compact(F.array(*[
        F.when(F.col("category").isin([p.category for p in profile_patterns("redact", o.enabled(), o.mask)]), F.lit(name))
        for name, o in SELECTIONS.items()
    ]))
    return counts.select(F.explode(chosen).alias("selection"), "category", "n")


@query("language_option")
def language_option(spark, sf):
    requested = F.when(F.col("doc_id") % 5 == 0, F.upper("lang")).when(F.col("doc_id") % 5 == 1, "xx").otherwise(F.col("lang"))
    docs = corpus.table(spark, sf, "documents").select("doc_id", requested.alias("requested"))
    return docs.select("doc_id", "requested", accepted_language(F.col("requested")).alias("language"))


@query("sensitive_prefix_filter")
def sensitive_prefix_filter(spark, sf):
    return corpus.corpus_pages(spark, sf).filter(headings.has_sensitive_prefix(F.col("text"))).select("doc_id", "page", "text")


@query("is_heading")
def is_heading(spark, sf):
    pages = corpus.corpus_pages(spark, sf)
    return pages.select("doc_id", "page", "lang", headings.is_heading(F.col("text"), F.col("lang")).alias("is_heading"))


@query("heading_taxonomy")
def heading_taxonomy(spark, sf):
    lines = corpus.corpus_pages(spark, sf).select("doc_id", "page", "text")
    return headings.classify_headings(lines).select("doc_id", "page", "form").filter(F.col("form").isNotNull())


@query("label_value_split")
def label_value_split(spark, sf):
    pages = corpus.corpus_pages(spark, sf)
    return pages.select(
        "doc_id", "page", headings.label_part(F.col("text")).alias("label"), headings.label_content(F.col("text")).alias("content")
    )


@query("heading_window_filter")
def heading_window_filter(spark, sf):
    found = detect.find(corpus.corpus_pages(spark, sf), profile_patterns("strict"), context=50)
    return found.select(
        "doc_id", "page", "category", "ordinal", "match_no", "value", "context",
        headings.is_heading(F.col("context"), "en").alias("in_heading"),
    )


@query("sensitive_flag")
def sensitive_flag(spark, sf):
    html = corpus.html_pages(spark, sf)
    return html.select("doc_id", detect.first_sensitive(F.col("text"), SECONDARY_FLAG).alias("kind")).filter("kind IS NOT NULL")


@query("sensitive_flag_minimal")
def sensitive_flag_minimal(spark, sf):
    html = corpus.html_pages(spark, sf)
    return html.select("doc_id", detect.first_sensitive(F.col("text"), SECONDARY_MINIMAL).isNotNull().alias("sensitive"))


# --------------------------------------------------- detection cells -------
CELL_NAMES = {
    "phone": "phone", "email": "email", "credit_card": "cc", "cvv": "cvv", "expiry": "expiry", "bic": "bic",
    "iban": "iban", "aadhaar": "aadhaar", "pan": "pan", "mask": "mask",
}
REDACT_CELLS = list(CELL_NAMES)
SCAN_CELLS = ["phone", "email", "credit_card", "cvv", "expiry", "bic", "iban", "mask"]
STRICT_CELLS = ["phone", "email", "credit_card", "cvv", "expiry", "bic", "iban", "aadhaar", "pan"]
TEXT_CELLS = ["phone", "email", "credit_card", "mask"]
ITEM_COLUMNS = ["doc_id", "value", "ordinal", "page", "match_no"]


def _redact_cell(category):
    def run(spark, sf):
        found = detect.cell(corpus.corpus_pages(spark, sf), "redact", category, MASK)
        return collate.report_items(found).select(*ITEM_COLUMNS)

    return run


def _raw_cell(profile, category):
    def run(spark, sf):
        pages = _lang_pages(spark, sf) if profile == "lang" else corpus.corpus_pages(spark, sf)
        return detect.cell(pages, profile, category, MASK).select(*ITEM_COLUMNS)

    return run


def _lang_pages(spark, sf):
    """The corpus with every fourth document asking for the Hindi rules."""
    asked = F.when(F.abs("doc_id") % 4 == 0, "hi").otherwise(F.col("lang"))
    return corpus.corpus_pages(spark, sf).withColumn("lang", asked)


def _text_cell(category):
    def run(spark, sf):
        docs = corpus.corpus_documents(spark, sf).select("doc_id", "text")
        out = mask.mask_text(docs, mask=MASK, items=True)
        return out.select("doc_id", F.posexplode(f"items_{category}").alias("item_no", "value"))

    return run


for _c in REDACT_CELLS:
    QUERIES[f"{CELL_NAMES[_c]}_redact"] = _redact_cell(_c)
for _c in SCAN_CELLS:
    QUERIES[f"{CELL_NAMES[_c]}_scan"] = _raw_cell("scan", _c)
for _c in STRICT_CELLS:
    QUERIES[f"{CELL_NAMES[_c]}_strict"] = _raw_cell("strict", _c)
    QUERIES[f"{CELL_NAMES[_c]}_lang"] = _raw_cell("lang", _c)
for _c in TEXT_CELLS:
    QUERIES[f"{CELL_NAMES[_c]}_text"] = _text_cell(_c)


@query("phone_intl")
def phone_intl(spark, sf):
    return international.international_phones(corpus.corpus_pages(spark, sf))


@query("mask_regex")
def mask_regex(spark, sf):
    return detect.regex_mask(corpus.corpus_pages(spark, sf), MASK_REGEX)


@query("pattern_match")
def pattern_match(spark, sf):
    rows = detect.match_pattern(corpus.document_pages(spark, sf), WORD_REGEX)
    return rows.select("doc_id", "page", "n", _listed("values"))


@query("secondary_text_scan")
def secondary_text_scan(spark, sf):
    return detect.scan_secondary(corpus.html_pages(spark, sf), SECONDARY_GROUPS)


FINDING_COLUMNS = ["doc_id", "page", "category", "cat_no", "ordinal", "match_no", "value"]


@query("findings_redact")
def findings_redact(spark, sf):
    return _redact(spark, sf, spans=True).select(*FINDING_COLUMNS, "start", "end")


@query("findings_scan")
def findings_scan(spark, sf):
    return detect.findings(corpus.corpus_pages(spark, sf), "scan").select(*FINDING_COLUMNS)


@query("findings_strict")
def findings_strict(spark, sf):
    return detect.findings(corpus.corpus_pages(spark, sf), "strict").select(*FINDING_COLUMNS)


@query("findings_lang")
def findings_lang(spark, sf):
    return detect.findings(_lang_pages(spark, sf), "lang").select(*FINDING_COLUMNS)


@query("findings_text")
def findings_text(spark, sf):
    docs = corpus.corpus_documents(spark, sf).select("doc_id", "text")
    out = mask.mask_text(docs, mask=MASK, items=True)
    lists = F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(f"items_{c}").alias("values")) for c in mask.TEXT_ORDER
    ])
    return out.select("doc_id", F.inline(lists)).select("doc_id", "category", F.posexplode("values").alias("item_no", "value"))


LABELLED_IBAN = (
    "concat('Account IBAN: GB', lpad(cast(o_orderkey % 97 as string), 2, '0'), "
    "translate(lpad(cast(o_orderkey * 104729 as string), 14, '0'), '0123456789', 'ABCDEFGHIJ'), ' of customer ', cast(o_custkey as string))"
)


@query("iban_labelled")
def iban_labelled(spark, sf):
    """Numbers with letters behind their check digits: found, and seen by the verifier where they stand unmasked."""
    rows = corpus.table(spark, sf, "orders").selectExpr("o_orderkey as doc_id", "1 as page", f"{LABELLED_IBAN} as text")
    patterns = category_patterns("redact", "iban")
    found = detect.find(rows, patterns).select("doc_id", F.lit("found").alias("kind"), "ordinal", "value")
    left = verify.leftover_matches(rows, patterns)
    return found.unionByName(left.select("doc_id", F.lit("left").alias("kind"), "ordinal", F.col("text").alias("value")))


# --------------------------------------------------- scalar functions ------
def _values(spark, sf, category):
    """Distinct unvalidated matches of one category."""
    found = detect.find(corpus.corpus_pages(spark, sf), category_patterns("redact", category), validate=False)
    return found.select("doc_id", "value").distinct()


def _check(name, category):
    def run(spark, sf):
        values = _values(spark, sf, category)
        return values.select("doc_id", "value", validators.VALIDATORS[name](F.col("value")).alias("valid"))

    return run


QUERIES["luhn_valid"] = _check("luhn", "credit_card")
QUERIES["verhoeff_valid"] = _check("aadhaar", "aadhaar")
QUERIES["iban_valid"] = _check("iban", "iban")
QUERIES["bic_valid"] = _check("bic", "bic")
QUERIES["pan_valid"] = _check("pan", "pan")


@query("normalise_value")
def normalise_value(spark, sf):
    found = detect.find(corpus.corpus_pages(spark, sf), profile_patterns("redact"), validate=False)
    values = found.select("doc_id", "category", "value").distinct()
    return values.select("doc_id", "category", "value", validators.normalise_value(F.col("category"), F.col("value")).alias("normalised"))


@query("match_spans")
def match_spans(spark, sf):
    found = detect.find(corpus.corpus_documents(spark, sf), profile_patterns("redact"), spans=True)
    return found.select("doc_id", "category", "ordinal", "match_no", "value", "start", "end")


@query("context_window")
def context_window(spark, sf):
    found = detect.find(corpus.corpus_documents(spark, sf), profile_patterns("redact"), context=20)
    return found.select("doc_id", "category", "ordinal", "match_no", "value", "context")


@query("escape_literal")
def escape_literal(spark, sf):
    literal = F.concat(F.col("p_name"), F.lit(r"+\E(1)"))
    part = corpus.table(spark, sf, "part").select("p_partkey", literal.alias("literal"))
    return part.select("p_partkey", "literal", validators.escape_literal(F.col("literal")).alias("regex"))


@query("mask_chars")
def mask_chars(spark, sf):
    return _values(spark, sf, "credit_card").select("doc_id", "value", validators.mask_chars(F.col("value")).alias("mask"))


# --------------------------------------------------------- masking ---------
@query("redact_block")
def redact_block(spark, sf):
    pages = corpus.corpus_pages(spark, sf)
    return redact_pages(pages, ALL).select("doc_id", "page", "text")


@query("redact_blur")
def redact_blur(spark, sf):
    pages = corpus.corpus_pages(spark, sf)
    options = RedactOptions(all_categories=True, blur=True, preserve_headings=False)
    return redact_pages(pages, options).select("doc_id", "page", "text")


@query("redact_folded")
def redact_folded(spark, sf):
    """What is found on the first page of a document is hidden on its other pages, where case and line ends differ."""
    pages = corpus.written_otherwise(corpus.corpus_documents(spark, sf))
    found = detect.findings(pages.where("page = 1"), "redact")
    return mask.mask_pages_folded(pages, mask.targets(found)).select("doc_id", "page", "text")


def _token(category):
    def run(spark, sf):
        docs = corpus.corpus_documents(spark, sf).select("doc_id", "text")
        return mask.mask_text(docs, [category], MASK)

    return run


QUERIES["redact_token_cc"] = _token("credit_card")
QUERIES["redact_token_phone"] = _token("phone")
QUERIES["redact_token_email"] = _token("email")
QUERIES["redact_token_masked"] = _token("mask")


@query("redact_text_pipeline")
def redact_text_pipeline(spark, sf):
    return mask.mask_text(corpus.corpus_documents(spark, sf).select("doc_id", "text"), mask=MASK)


@query("redact_document_pipeline")
def redact_document_pipeline(spark, sf):
    """Find and mask documents stored one per row, then split them into pages."""
    options = RedactOptions(all_categories=True, mask=MASK)
    docs = corpus.corpus_documents(spark, sf).select("doc_id", "text", "lang")
    return corpus.split_pages(redact_documents(docs, options)).select("doc_id", "page", "text")


@query("drop_sensitive_text")
def drop_sensitive_text(spark, sf):
    html = corpus.html_pages(spark, sf)
    flag = detect.first_sensitive(F.col("text"), SECONDARY_FLAG).isNotNull()
    return mask.drop_sensitive(html, flag).select("doc_id", "text")


# ----------------------------------------------------------- joins ---------
@query("pages_x_patterns")
def pages_x_patterns(spark, sf):
    patterns = profile_patterns("text", ["phone", "credit_card"])
    rows = [(i, p.regex, p.ignore_case) for i, p in enumerate(patterns, 1)]
    table = spark.createDataFrame(rows, "pattern_id int, regex string, ignore_case boolean")
    return detect.match_pattern_table(corpus.corpus_pages(spark, sf), table)


@query("pattern_table_large")
def pattern_table_large(spark, sf):
    """Every page against a table of up to 5,000 patterns, one for each of the first long words of the documents."""
    docs = corpus.table(spark, sf, "documents")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{7,}"), F.lit(0))).alias("w")).distinct().orderBy("w").limit(5000)
    table = words.select(
        F.row_number().over(Window.orderBy("w")).alias("pattern_id"), F.concat("w", F.lit("(?:s|es)?[,.]")).alias("regex"), F.lit(False).alias("ignore_case"))
    return detect.match_large_pattern_table(corpus.document_pages(spark, sf), table)


@query("doc_matches_to_pages")
def doc_matches_to_pages(spark, sf):
    return mask.targets_on_pages(corpus.corpus_pages(spark, sf), mask.targets(_redact(spark, sf)))


@query("lang_pattern_lookup")
def lang_pattern_lookup(spark, sf):
    asked = F.when(F.col("doc_id") % 4 == 0, "hi").otherwise(F.col("lang"))
    docs = corpus.table(spark, sf, "documents").select("doc_id", asked.alias("lang"))
    return lookup.pattern_sets(docs).groupBy("doc_id", "lang", "set_lang", "category").agg(F.count(F.lit(1)).alias("n_patterns"))


@query("lang_heading_lookup")
def lang_heading_lookup(spark, sf):
    asked = F.when(F.col("doc_id") % 4 == 0, "hi").when(F.col("doc_id") % 4 == 1, "it").otherwise(F.col("lang"))
    docs = corpus.table(spark, sf, "documents").select("doc_id", asked.alias("lang"))
    return lookup.heading_sets(docs)


@query("lang_memo_join")
def lang_memo_join(spark, sf):
    pages = corpus.document_pages(spark, sf).drop("lang")
    return language.detect_distinct(pages, _profile(spark, sf))


@query("unredacted_semi_join")
def unredacted_semi_join(spark, sf):
    masked = redact_pages(corpus.corpus_pages(spark, sf), ALL)
    left = detect.find(masked, verify.strict_again(profile_patterns("redact"))).select("doc_id").distinct()
    docs = corpus.corpus_documents(spark, sf).select("doc_id")
    return docs.join(left, "doc_id", "left_semi")


@query("category_dim_left_join")
def category_dim_left_join(spark, sf):
    docs = corpus.corpus_documents(spark, sf).select("doc_id")
    return collate.zero_filled(docs, collate.category_counts(_redact(spark, sf)))


# ------------------------------------- aggregates, distinct, windows -------
@query("count_per_page")
def count_per_page(spark, sf):
    rows = detect.page_counts(corpus.corpus_pages(spark, sf), profile_patterns("scan"))
    return rows.select("doc_id", "page", F.array_join("counts", ",").alias("counts"))


@query("count_per_category")
def count_per_category(spark, sf):
    return collate.category_counts(_redact(spark, sf))


@query("total_items")
def total_items(spark, sf):
    return collate.totals(collate.category_counts(_redact(spark, sf)))


@query("sensitivity_summary")
def sensitivity_summary(spark, sf):
    found = detect.findings(corpus.corpus_pages(spark, sf), "scan")
    images = detect.scan_secondary(corpus.html_pages(spark, sf), SECONDARY_GROUPS)
    return report.sensitivity_summary(found, images)


@query("nonzero_categories")
def nonzero_categories(spark, sf):
    return collate.found_phrase(collate.category_counts(_redact(spark, sf)))


@query("doc_target_list")
def doc_target_list(spark, sf):
    distinct = mask.targets(_redact(spark, sf))
    return collate.ranked(distinct, ["doc_id"], collate.ORDER, "position").select("doc_id", "position", "value", "hide")


@query("distinct_ordered")
def distinct_ordered(spark, sf):
    return collate.first_seen(_redact(spark, sf, categories=["phone", "aadhaar", "pan"])).select(
        "doc_id", "category", "value", "ordinal", "page", "match_no"
    )


@query("distinct_set")
def distinct_set(spark, sf):
    found = _redact(spark, sf, categories=["credit_card", "cvv", "expiry", "bic", "iban"])
    return found.select("doc_id", "category", "value").distinct()


@query("union_matches")
def union_matches(spark, sf):
    pages = corpus.corpus_pages(spark, sf)
    library = international.international_phones(pages).select("doc_id", "page", "value", F.lit("library").alias("origin"))
    regexes = [p for p in category_patterns("redact", "phone") if p.ordinal > 0]
    found = detect.find(pages, regexes).select("doc_id", "page", "value", F.lit("regex").alias("origin"))
    return library.unionByName(found)


@query("recommendation")
def recommendation(spark, sf):
    found = detect.findings(corpus.corpus_pages(spark, sf), "scan")
    counts = found.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n_items"))
    return report.recommendation(counts)


@query("first_seen_rank")
def first_seen_rank(spark, sf):
    found = collate.first_seen(_redact(spark, sf))
    return collate.ranked(found, ["doc_id", "category"], ["ordinal", "page", "match_no"], "position").select(
        "doc_id", "category", "value", "position"
    )


@query("first_category")
def first_category(spark, sf):
    """No category is looked for behind the first one of a document."""
    return collate.first_category(detect.first_categories(corpus.corpus_documents(spark, sf))).where("category IS NOT NULL")


@query("lang_top1")
def lang_top1(spark, sf):
    return language.best_language(language.scores(corpus.whole_documents(spark, sf).drop("lang"), _profile(spark, sf)))


@query("last_pattern_wins")
def last_pattern_wins(spark, sf):
    docs = corpus.corpus_documents(spark, sf)
    left = verify.text_leftovers(docs)
    return left.select("doc_id", "category", "ordinal", "n_left", _listed("values"))


@query("page_order")
def page_order(spark, sf):
    pages = corpus.conversation_pages(spark, sf)
    return detect.match_pattern(pages, r"\b[a-z]+ing\b").select("doc_id", "page", "n").orderBy("doc_id", "page")


@query("page_job")
def page_job(spark, sf):
    """Find, mask, write, report and verify: what each step stored, per document."""
    docs = corpus.corpus_documents(spark, sf).select("doc_id")
    options = RedactOptions(all_categories=True, verify=True)
    run = run_page_job(corpus.corpus_pages(spark, sf), options, shared_dir(spark, "page-job"))
    one = lambda rows, n: rows.groupBy("doc_id").agg(n)
    found = one(run.findings, F.count(F.lit(1)).alias("n_findings"))
    listed = one(run.report, F.sum("n_items").cast("long").alias("n_items"))
    hidden = one(run.masked, F.sum(F.length("text") - F.length(F.replace("text", F.lit(mask.BLOCK_CHAR), F.lit("")))).alias("n_hidden"))
    rest = run.summary.select("doc_id", "n_issues", "success")
    rows = docs.join(found, "doc_id", "left").join(listed, "doc_id", "left").join(hidden, "doc_id", "left").join(rest, "doc_id", "left")
    return rows.na.fill(0, ["n_findings", "n_items", "n_hidden", "n_issues"])


# ------------------------------------------------------ verification -------
def _masked(spark, sf):
    return redact_pages(corpus.corpus_pages(spark, sf), ALL)


@query("verify_text")
def verify_text(spark, sf):
    return verify.leftover_matches(_masked(spark, sf), profile_patterns("redact"))


@query("verify_words")
def verify_words(spark, sf):
    return verify.leftover_words(_masked(spark, sf), profile_patterns("redact"))


@query("verify_summary")
def verify_summary(spark, sf):
    masked = _masked(spark, sf)
    issues = detect.find(masked, verify.strict_again(profile_patterns("redact")))
    return verify.summary(corpus.corpus_documents(spark, sf), issues)


@query("verify_secondary")
def verify_secondary(spark, sf):
    html = corpus.html_pages(spark, sf)
    flag = detect.first_sensitive(F.col("text"), SECONDARY_MINIMAL).isNotNull()
    return verify.leftover_secondary(mask.drop_sensitive(html, flag), profile_patterns("redact"))


@query("verify_text_pipeline")
def verify_text_pipeline(spark, sf):
    docs = corpus.corpus_documents(spark, sf).select("doc_id", "text")
    left = verify.text_leftovers(mask.mask_text(docs, mask=MASK), mask=MASK)
    return left.select("doc_id", "category", "ordinal", "n_left", _listed("values"))


# ---------------------------------------------------------- language -------
def _profile(spark, sf):
    return language.trained(corpus.whole_documents(spark, sf).select("text", "lang"))


@query("lang_profiles")
def lang_profiles(spark, sf):
    return language.profiles(corpus.whole_documents(spark, sf).select("text", "lang"))


@query("lang_detect")
def lang_detect(spark, sf):
    return language.detect_language(corpus.whole_documents(spark, sf).drop("lang"), _profile(spark, sf))


@query("lang_route")
def lang_route(spark, sf):
    """Every third document asks for a language; the others are detected."""
    pages = corpus.whole_documents(spark, sf).drop("lang")
    detected = language.detect_language(pages, _profile(spark, sf))
    asked = F.when(F.col("doc_id") % 3 == 0, "fr").otherwise("auto")
    chosen = detected.select("doc_id", "page", asked.alias("requested"), F.col("lang").alias("detected"))
    return chosen.select(
        "doc_id", "requested", F.when(F.col("requested") == "auto", F.col("detected")).otherwise(F.col("requested")).alias("language")
    )


# --------------------------------------------------------- streaming -------
@query("stream_redact")
def stream_redact(spark, sf):
    source = redact_stream.document_stream(spark, sf, "documents.parquet")
    out = shared_dir(spark, "stream-out")
    run = redact_stream.start_redaction(
        source, RedactOptions(categories=("credit_card", "phone", "email"), mask=MASK), out, shared_dir(spark, "stream-state")
    )
    run.awaitTermination()
    return spark.read.schema("doc_id bigint, text string").parquet(out)


def _page_parts(spark, sf, *columns):
    """Folder of the corpus pages in four parts, written one after the other, each in as many files as there are tasks; their number."""
    parts = shared_dir(spark, "stream-pages")
    pages = corpus.corpus_pages(spark, sf).select("doc_id", "page", "text", *columns)
    for part in range(4):
        pages.where(F.col("page") % 4 == part).write.mode("append").parquet(parts)
    return parts, len(spark.read.parquet(parts).inputFiles())


@query("stream_counts")
def stream_counts(spark, sf):
    """Item counts of a stream whose micro-batches split the documents between their pages."""
    parts, files = _page_parts(spark, sf)
    source = spark.readStream.schema("doc_id bigint, page int, text string").option("maxFilesPerTrigger", -(-files // 2)).parquet(parts)
    out = shared_dir(spark, "stream-counts")
    run = redact_stream.start_counts(source, RedactOptions(all_categories=True), out, shared_dir(spark, "stream-state"))
    run.awaitTermination()
    return redact_stream.read_counts(spark, out)


@query("stream_counts_compacted")
def stream_counts_compacted(spark, sf):
    """As ``stream_counts``, read from a generation of the closed batches and the newest batch."""
    (parts, files), out = _page_parts(spark, sf), shared_dir(spark, "stream-counts")
    source = spark.readStream.schema("doc_id bigint, page int, text string").option("maxFilesPerTrigger", -(-files // 4)).parquet(parts)
    redact_stream.start_counts(source, RedactOptions(all_categories=True), out, shared_dir(spark, "stream-state")).awaitTermination()
    generations.compact(spark, out)
    return redact_stream.read_counts(spark, out)


@query("stream_pages")
def stream_pages(spark, sf):
    """The page job on a stream whose micro-batches split the documents between their pages."""
    (parts, files), out = _page_parts(spark, sf, "lang"), shared_dir(spark, "stream-masked")
    source = spark.readStream.schema("doc_id bigint, page int, text string, lang string").option("maxFilesPerTrigger", -(-files // 2)).parquet(parts)
    page_stream.start_pages(source, ALL, out, shared_dir(spark, "stream-state")).awaitTermination()
    return page_stream.read_pages(spark, out)
