"""Steps that many queries share: how the work is dealt out, and what a row costs."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from inkveil.functions import pyregex, validators
from inkveil.functions.patterns import Pattern, profile_patterns
from inkveil.operators import collate, detect, report, verify
from inkveil.plans import catalog
from inkveil.sources import corpus, document_files, session


def test_notes_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path):
    rows = 100_000
    pq.write_table(pa.table({"o_orderkey": pa.array(range(rows), pa.int64())}), tmp_path / "orders.parquet", row_group_size=rows)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")  # many splits, of which one holds the row group
    try:
        counts = corpus.notes(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(name, before)
    assert sum(r["count"] for r in counts) == rows and max(r["count"] for r in counts) < rows / 4


def test_checks_take_a_value_apart_once(spark):
    values = spark.createDataFrame([("DE89 3704 0044 0532 0130 00", True), ("DE88370400440532013000", False), (None, False), ("", False)], "v string, ok boolean")
    checked = values.select("ok", validators.iban_valid(F.col("v")).alias("got"))
    assert all(r["ok"] == r["got"] for r in checked.collect())
    numbers = values.select(validators.verhoeff_valid(F.col("v")).alias("got"))
    for rows in (checked, numbers):  # a translation written into the loop runs for every character
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_patterns_of_a_page_without_their_literal_do_not_run(spark):
    pages = spark.createDataFrame([(1, 1, "CVV: 123"), (1, 2, "a 123 ſecurity code: 456"), (1, 3, None)], "doc_id long, page int, text string")
    patterns = profile_patterns("redact", ["cvv"])
    lists = detect._match_lists(pages, patterns, None)[0]
    assert "_small" in lists.columns and "_card_label" not in lists.columns
    assert sorted((r["page"], r["ordinal"], r["value"]) for r in detect.find(pages, patterns).collect()) == [
        (1, 1, "CVV: 123"), (2, 4, "ſecurity code: 456")]


def test_spans_of_single_matches(spark):
    texts = ["ab 12", "x12 12", "12 x12", "\U0001F600 12", "12", "12 12 12", "none"]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")
    found = detect.find(pages, [Pattern("custom", 0, 1, r"\b12\b")], spans=True, context=2)
    got = sorted((r["doc_id"], r["start"], r["end"], r["context"]) for r in found.collect())
    assert got == [(0, 3, 5, "b 12"), (1, 4, 6, "2 12"), (2, 0, 2, "12 x"), (3, 2, 4, "\U0001F600 12"), (4, 0, 2, "12"),
                   (5, 0, 2, "12 1"), (5, 3, 5, "2 12 1"), (5, 6, 8, "2 12")]


def test_parts_of_a_stream_are_many_files(spark):
    parts, files = catalog._page_parts(spark, "/root/testdata/sf0.001")
    stored = spark.read.parquet(parts)
    assert files > 8 and stored.count() == corpus.corpus_pages(spark, "/root/testdata/sf0.001").count()
    mixed = stored.groupBy(F.input_file_name()).agg(F.countDistinct(F.col("page") % 4).alias("n")).where("n > 1")
    assert mixed.isEmpty()


def test_groups_by_document_need_no_second_shuffle(spark):
    small = "/root/testdata/sf0.001"
    for name in ("first_category", "count_per_category", "redaction_report"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, name


def test_conditions_of_long_numbers_lose_no_match(spark):
    texts = ["4532015100020026 x", "3400 000000 00009", "a 1234567890123.", "123456789012345", "0123 4567890", "0123-456 789", "ABCDE1234F,", "abcde1234f", "DEUTDEFF500", "DEUTDE"]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)] + [(99, 1, None)], "doc_id long, page int, text string")
    patterns = profile_patterns("redact")
    assert {"_run6", "_run13", "_capitals", "_tax_number"} <= set(detect._match_lists(pages, patterns, None)[0].columns)
    got = {(r["doc_id"], r["category"], r["ordinal"], r["match_no"], r["value"]) for r in detect.find(pages, patterns, validate=False).collect()}
    want = {(i, p.category, p.ordinal, n, m.group()) for i, t in enumerate(texts) for p in patterns for n, m in enumerate(re.compile(p.regex, p.flags).finditer(t))}
    assert got == want and len(want) > 8


def test_uncut_reports_store_nothing(spark):
    found = spark.createDataFrame([(1, "phone", 1, 1, 1, 0, "a"), (1, "pan", 10, 1, 1, 0, "b"), (1, "phone", 1, 1, 2, 0, "a"), (None, "pan", 10, 1, 1, 0, "b")],
                                  "doc_id long, category string, cat_no int, ordinal int, page int, match_no int, value string")
    before = len(session.WORK_FOLDERS)
    rows = {(r["doc_id"], r["part"], r["category"], r["n_items"], r["total_items_redacted"], tuple(r["items"])) for r in report.redaction_report(found).collect()}
    assert rows == {(1, 0, "phone", 1, 2, ("a",)), (1, 0, "pan", 1, 2, ("b",))}
    assert len(session.WORK_FOLDERS) == before


def test_written_files_are_listed_by_folder(spark, tmp_path):
    pages = spark.createDataFrame([(i, 1, f"text {i}") for i in range(40)], "doc_id long, page int, text string")
    names = spark.createDataFrame([(i, f"a/d{i}.txt") for i in range(40)], "doc_id long, path string")
    document_files.write_masked_files(pages, names, str(tmp_path / "out"))
    stored = document_files.read_files(spark, str(tmp_path / "out"))
    paths = re.search(r"InMemoryFileIndex\((\d+) paths\)", stored._jdf.queryExecution().executedPlan().toString())
    assert stored.count() == 40 and int(paths.group(1)) <= 8


LINED = [
    "PAN: ABCFE1234F\nPhone: 555-123-4567", "4532 0151\n1234 5678", "CVV\n: 123", "CVV: 123\x01\nx", "a\x01b@c.de", "", "no value", "\n\nBIC: DEUTDEFF500",
    "2345\x016789 0123", "٢٣٤٥ 6789 0124\n+49 30 1234567", "IBAN: DE44500105175407324931", "Expiry: 03/25\nä CVV: 123", "0123 456789", "5551234567\n1", "a@b.de\nc@d.ef\na@b.de",
]


def _lined(spark):
    rows = [(i, t, "en") for i, t in enumerate(LINED)] + [(90, None, "en"), (None, "CVV: 123", "en"), (None, "Phone: 555-123-4567", "en"), (1, "Phone: 555-123-4567", "en"),
                                                        (3, "CVV: 123\nCVV: 124", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_first_category_is_that_of_all_findings(spark):
    docs = _lined(spark)
    for profile in ("redact", "scan"):
        got = collate.first_category(detect.first_categories(docs, profile)).where("category IS NOT NULL")
        want = collate.first_category(detect.findings(corpus.split_pages(docs), profile))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and want.count() > 8
    plan = catalog.QUERIES["first_category"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # neither pages nor findings become rows


def test_conditions_of_dates_and_bank_codes_lose_no_match(spark):
    texts = ["03/25", "x 12-2031.", "13/25", "Expiry 03-25", "May 2024", "may,, 2024", "Auguſt 2024", "Dec\n٢٠٢٤", "June2024", "DEUTDEFF", "SWIFT: DEUTDEFF500",
             "BIC DEUTD", "GB29NWBK60161331926819", "IBAN: DE44500105175407324931", "AB12ABCD123456", "555-123-4567", "10-1 2", "0٣/25"]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)] + [(99, 1, None)], "doc_id long, page int, text string")
    patterns = profile_patterns("lang") + profile_patterns("strict")
    assert {"_month_number", "_month_name", "_capitals", "_run6"} <= set(detect._match_lists(pages, patterns, None)[0].columns)
    assert {p.guard for p in profile_patterns("lang") if p.category == "bic"} == {"capitals"}
    got = sorted((r["doc_id"], r["category"], r["ordinal"], r["match_no"], r["value"]) for r in detect.find(pages, patterns, validate=False).collect())
    want = sorted((i, p.category, p.ordinal, n, m.group()) for i, t in enumerate(texts) for p in patterns for n, m in enumerate(re.compile(p.regex, p.flags).finditer(t)))
    assert got == want and len(want) > 20


def test_left_words_are_those_of_a_search_word_by_word(spark):
    texts = ["CVV: 123 x\tCVV:123", "a@b.de, c@d.ef", "GB29 6016 1331 9268 1912 3456", "DE44500105175407324931 123", "IBAN:DE44500105175407324931", "555-123-4567\x1c555.246.8135", "(555) 123-4567",
             "4532015112830366;", "٤٥٣٢٠١٥١١٢٨٣٠٣٦٦ 05/26", "Expiry:05/26 Exp:05/26", "ABCFE1234F,DEUTDEFF500", "nothing here", "", "  ", "the end of the", "ä the", "DE44 5001 0517 5407 3249 1"]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)] + [(99, 1, None), (None, 2, "DEUTDEFF500"), (0, 1, "CVV:123")], "doc_id long, page int, text string")
    patterns = profile_patterns("redact", mask="the") + [Pattern("custom", 0, 1, r"end$"), Pattern("custom", 0, 2, r"^the(?! end)"), Pattern("custom", 0, 3, r"(?>a*)a|x++")]
    rows = verify.leftover_words(pages, patterns)
    got = sorted((tuple(r) for r in rows.collect()), key=str)
    want = sorted((
        (r["doc_id"], r["page"], "unredacted_word", p.category, p.ordinal, n, w) for r in pages.collect() for n, w in enumerate(re.findall(r"\S+", r["text"] or ""))
        for p in verify.strict_again(patterns) if re.search(p.regex, w, p.flags)), key=str)
    assert got == want and len(want) > 25
    # Words without a match never become rows, and no page is expanded that has none.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_patterns_that_look_beyond_a_word():
    assert all(pyregex.looks_no_further(r) for r in (r"\ba+(?:b|c)?\d{2,}?", r"[^a]x.", r"(a)\s*b"))
    assert not any(pyregex.looks_no_further(r) for r in (r"^a", r"a$", r"a(?!b)", r"(?<=a)b", r"a\B", r"(?:a(?=b))?", r"a++b", r"(?>a|ab)c", r"(a)\1", r"\Aa"))
