"""One fixture document: a value of every category, line by line."""

import pytest
from pyspark.sql import functions as F

from inkveil.functions import headings
from inkveil.operators import detect, mask, report, verify
from inkveil.functions.patterns import profile_patterns
from inkveil.plans.options import RedactOptions
from inkveil.plans.pipelines import redact_pages, run_page_job

LINES = [
    "CONFIDENTIAL - Employee Record", "Personal Information",
    "Mobile: +1-555-123-4567", "Home: (555) 987-6543", "Work: 555.246.8135", "India Mobile: +91 9876543210",
    "Personal: john.doe@gmail.com", "Work: jdoe@company.org", "Alternate: jane_smith+work@example.co.uk",
    "Visa: 4532 0151 2345 6789", "Mastercard: 5425-2334-3456-7890", "Amex: 371449635398431",
    "CVV: 123", "Expiry: 05/26", "Aadhaar: 2234 5678 9012", "PAN: ABCPD1234E",
    "IBAN: DE89370400440532013000", "BIC: COBADEFFXXX", "Aadhaar: 2234 5678 9018",
    "555.246 8135", "John-doe@x.com", "user at domain dot com", "user[at]domain[dot]com", "Cvv 123", "abc(555) 123-4567",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, i, t, "en") for i, t in enumerate(LINES, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, page int, text string, lang string")


@pytest.fixture(scope="module")
def by_page(pages):
    out = {}
    for r in detect.findings(pages, "redact").collect():
        out.setdefault(r["page"], set()).add((r["category"], r["ordinal"], r["value"]))
    return out


def values(found, category):
    return {v for c, _, v in found if c == category}


@pytest.mark.parametrize(
    "page, category, expected",
    [
        (3, "phone", {"1-555-123-4567", "+1-555-123-4567"}),
        (4, "phone", {"555) 987-6543"}),
        (5, "phone", {"555.246.8135"}),
        (6, "phone", {"9876543210", "+91 9876543210"}),
        (7, "email", {"john.doe@gmail.com"}),
        (8, "email", {"jdoe@company.org"}),
        (9, "email", {"jane_smith+work@example.co.uk"}),
        (10, "credit_card", {"4532 0151 2345 6789"}),
        (11, "credit_card", {"5425-2334-3456-7890"}),
        (12, "credit_card", {"371449635398431"}),
        (13, "cvv", {"CVV: 123"}),
        (14, "expiry", {"Expiry: 05/26"}),
        (15, "aadhaar", set()),
        (16, "pan", {"ABCPD1234E"}),
        (17, "iban", {"DE89370400440532013000", "IBAN: DE89370400440532013000"}),
        (18, "bic", {"COBADEFFXXX", "BIC: COBADEFFXXX"}),
        (19, "aadhaar", {"2234 5678 9018"}),
        (20, "phone", {"555.246 8135"}),
        (21, "email", {"John-doe@x.com"}),
        (22, "email", {"user at domain dot com"}),
        (23, "email", {"user[at]domain[dot]com"}),
        (24, "cvv", {"Cvv 123"}),
        (25, "phone", {"(555) 123-4567"}),
    ],
)
def test_findings(by_page, page, category, expected):
    assert values(by_page.get(page, set()), category) == expected


def test_nothing_found_in_plain_lines(by_page):
    assert 1 not in by_page and 2 not in by_page


def test_masked_lines(pages):
    masked = {r["page"]: r["text"] for r in redact_pages(pages, RedactOptions(all_categories=True)).collect()}
    assert masked[4] == "Home: (" + "█" * 13
    assert masked[7] == "Personal: " + "█" * 18
    assert masked[13] == "█" * 8
    assert masked[14] == "Expiry: " + "█" * 5
    assert masked[15] == LINES[14]
    assert masked[18] == "█" * 16
    # Found, but kept as a heading.
    assert masked[21] == LINES[20]
    for page, text in masked.items():
        assert len(text) == len(LINES[page - 1])


def test_bare_bic_is_kept_as_heading(spark):
    df = spark.createDataFrame([("COBADEFFXXX",), ("BIC: COBADEFFXXX",), ("Overview of x",), ("pan: X",)], "v string")
    got = [r[0] for r in df.select(headings.is_heading(F.col("v"))).collect()]
    assert got == [True, False, True, False]


def test_verifier_is_stricter_than_finder(pages):
    """Case-sensitive and without validators."""
    issues = verify.leftover_matches(pages, profile_patterns("redact")).collect()
    seen = {(r["page"], r["category"]) for r in issues}
    assert (15, "aadhaar") in seen  # not validated any more
    assert (24, "cvv") not in seen  # "Cvv" is not "CVV"
    context = [r for r in issues if r["page"] == 13 and r["category"] == "cvv"][0]["context"]
    assert context == "CVV: 123"


def test_complete_job(pages, tmp_path):
    options = RedactOptions(all_categories=True, mask="Personal", verify=True)
    run = run_page_job(pages, options, str(tmp_path))
    total = {r["total_items_redacted"] for r in run.report.collect()}
    listed = sum(r["n_items"] for r in run.report.collect())
    assert total == {listed}
    assert run.summary.collect()[0]["success"] is False
    texts = pages.sparkSession.read.text(str(tmp_path / "redaction_report")).collect()
    assert len(texts) == 1 and '"Custom Mask":["Personal","Personal"]' in texts[0][0]


def test_report_only_writes_no_masked_text(pages, tmp_path):
    run = run_page_job(pages, RedactOptions(all_categories=True, report_only=True), str(tmp_path))
    assert run.masked is None and not (tmp_path / "masked").exists()
    assert (tmp_path / "sensitivity_report").exists()


def test_report_parts_hold_everything(pages):
    found = detect.findings(pages, "redact")
    one = report.redaction_report(found).collect()
    many = report.redaction_report(found, part_pages=5).collect()
    flat = lambda rows: sorted((r["category"], v) for r in rows for v in r["items"])
    assert flat(one) == flat(many) and len({r["part"] for r in many}) > 1


def test_language_keeps_its_own_headings(spark):
    rows = [(1, 1, "resumen at mail dot com", "es"), (1, 2, "resumen at mail dot com", "en")]
    pages = spark.createDataFrame(rows, "doc_id bigint, page int, text string, lang string")
    out = mask.mask_pages(pages, mask.targets(detect.findings(pages, "redact")))
    texts = {r["page"]: r["text"] for r in out.collect()}
    assert texts == {1: rows[0][2], 2: "█" * len(rows[1][2])}
