"""Operators against plain Python on small random inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkveil.functions import headings
from inkveil.functions import patterns as P
from inkveil.functions import validators as V
from inkveil.functions.spans import BLOCK
from inkveil.operators import collate, detect, language, mask, verify
from inkveil.plans.options import RedactOptions
from inkveil.plans.pipelines import with_language
from inkveil.sources import corpus
from inkveil.streaming import redact_stream
from tests.conftest import SMALL

PAGES = "doc_id bigint, page int, text string, lang string"


def luhn(v):
    d = [int(c) for c in re.sub(r"[-\s]", "", v)]
    return (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0


def mod97(v):
    v = re.sub(r"\s", "", v.upper())
    return bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{4,}", v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def test_checksums(spark):
    rng = random.Random(1)
    cards = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(300)] + ["4532 0151 2345 6789"]
    rows = spark.createDataFrame([(c,) for c in cards], "v string").select("v", V.luhn_valid(F.col("v")).alias("ok")).collect()
    assert all(r["ok"] == luhn(r["v"]) for r in rows) and any(r["ok"] for r in rows)
    ibans = ["DE" + "".join(rng.choice("0123456789") for _ in range(20)) for _ in range(600)] + ["gb82 WEST 1234 5698 7654 32", "IBAN: X"]
    rows = spark.createDataFrame([(c,) for c in ibans], "v string").select("v", V.iban_valid(F.col("v")).alias("ok")).collect()
    assert all(r["ok"] == mod97(r["v"]) for r in rows) and any(r["ok"] for r in rows)


def test_verhoeff_finds_every_single_digit_error(spark):
    good = "223456789018"
    bad = [good[:i] + d + good[i + 1:] for i in range(12) for d in "0123456789" if d != good[i]]
    df = spark.createDataFrame([(v,) for v in [good, "2234 5678 9018", "२२३४५६७८९०१८", *bad, "12", "x"]], "v string")
    ok = [r["v"] for r in df.filter(V.verhoeff_valid(F.col("v"))).collect()]
    assert ok == [good, "2234 5678 9018", "२२३४५६७८९०१८"]


WORDS = [
    "é4111111111111111", "4111 1111 1111 1111", "4532015123456789.", "555-123-4567", "(555) 987-6543", "x555-123-4567",
    "a.b@c.de", "Éa@b.fr", "CVV: 123", "cvc123", "123 CVV", "Expiry: 05/26", "DE89370400440532013000", "COBADEFFXXX",
    "Straße", "नमस्ते", "ABCPD1234E", "12345", "2234 5678 9018", "IBAN: DE89370400440532013000", "\t", "😀", "05/26", "May 2024",
]


def random_pages(seed, n=60):
    rng = random.Random(seed)
    return [(i // 3, i % 3 + 1, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))), "en") for i in range(n)]


@pytest.mark.parametrize("profile", ["redact", "scan", "strict", "text"])
def test_matches_and_spans_equal_python(spark, profile):
    rows = random_pages(7)
    patterns = [p for p in P.profile_patterns(profile) if p.ordinal > 0]
    want = {
        (d, g, p.category, p.ordinal, i, m.group(), m.start(), m.end())
        for d, g, text, _ in rows for p in patterns
        for i, m in enumerate(re.finditer(p.regex, text, re.IGNORECASE if p.ignore_case else 0))
    }
    found = detect.find(spark.createDataFrame(rows, PAGES), patterns, spans=True, validate=False)
    got = {tuple(r) for r in found.select("doc_id", "page", "category", "ordinal", "match_no", "value", "start", "end").collect()}
    assert got == want


def test_spans_over_many_blocks(spark):
    text = "é " + " ".join(f"{i:04d}" for i in range(3 * BLOCK + 5))
    pages = spark.createDataFrame([(1, 1, text, "en")], PAGES)
    found = detect.find(pages, [P.Pattern("x", 1, 1, r"\b\d{4}\b")], spans=True, context=3).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in found] == [m.span() for m in re.finditer(r"\b\d{4}\b", text)]
    assert all(r["context"] == text[max(0, r["start"] - 3): r["end"] + 3] for r in found)


def text_job(text, mask_word):
    items = {}
    for category in P.TEXT_ORDER:
        for p in P.category_patterns("text", category, mask_word):
            regex = r"\b" + re.escape(mask_word) + r"\b" if category == "mask" else p.regex
            for m in list(re.finditer(regex, text)):
                items.setdefault(category, []).append(m.group())
                text = text.replace(m.group(), P.TEXT_TOKEN[category])
    return text, items


@pytest.mark.parametrize("mask_word", ["CVV", "REDACTED", "a.b"])
def test_text_job_equals_python(spark, mask_word):
    rows = random_pages(11) + [(99, 1, "1234, 123456789", "en"), (98, 1, "REDACTED x REDACTED 555-123-4567", "en")]
    docs = spark.createDataFrame([(i, t) for i, (_, _, t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in mask.mask_text(docs, mask=mask_word, items=True).collect()}
    for i, (_, _, text, _) in enumerate(rows):
        masked, items = text_job(text, mask_word)
        assert got[i]["text"] == masked
        assert {c: got[i][f"items_{c}"] for c in P.TEXT_ORDER if got[i][f"items_{c}"]} == items


def test_text_job_reports_leftovers(spark):
    docs = spark.createDataFrame([(1, "1234, 123456789"), (2, "nothing")], "doc_id bigint, text string")
    left = verify.text_leftovers(mask.mask_text(docs)).collect()
    assert [(r["doc_id"], r["category"], r["values"]) for r in left] == [(1, "phone", ["56789"])]


def test_filter_after_text_job_stays_small(spark):
    docs = spark.createDataFrame([(1, "a 555-123-4567")], "doc_id bigint, text string")
    out = mask.mask_text(docs, mask="a").filter(F.col("text").contains("PHONE"))
    assert out.count() == 1
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def page_job(rows, found):
    """Every value found anywhere in a document, first seen first, hidden on all its pages."""
    out = {}
    for d, g, text, _ in rows:
        seen = []
        for f in sorted((f for f in found if f["doc_id"] == d), key=lambda f: (f["cat_no"], f["ordinal"], f["page"], f["match_no"])):
            if f["value"] not in seen:
                seen.append(f["value"])
        for v in seen:
            text = text.replace(v, "*" * len(v))
        out[d, g] = text
    return out


@pytest.mark.parametrize("limit", [0, 2, 1000])
def test_page_job_equals_python_for_small_and_large_documents(spark, limit):
    rows = random_pages(3) + [(500, 1, "call 555-123-4567 x", "en"), (500, 2, "id99555-123-456788 and a.b@c.de", "en")]
    pages = spark.createDataFrame(rows, PAGES)
    found = detect.findings(pages, "redact", mask="May").collect()
    wanted = mask.targets(detect.findings(pages, "redact", mask="May"), preserve_headings=False)
    got = {(r["doc_id"], r["page"]): r["text"] for r in mask.mask_pages(pages, wanted, True, limit).collect()}
    assert got == page_job(rows, found)
    assert got[500, 2].startswith("id99************88")


@pytest.mark.parametrize("preserve", [True, False])
def test_documents_in_one_row_give_the_same_text(spark, preserve):
    docs = corpus.corpus_documents(spark, SMALL).select("doc_id", "text", "lang")
    pages = corpus.split_pages(docs)
    wanted = mask.targets(detect.findings(pages, "redact", mask="the"), preserve)
    by_page = mask.mask_pages(pages, wanted).select("doc_id", "page", "text")
    in_row = corpus.split_pages(mask.mask_documents(docs, mask="the", preserve_headings=preserve)).select("doc_id", "page", "text")
    assert by_page.exceptAll(in_row).isEmpty() and by_page.count() == in_row.count()
    stored = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert "Exchange" not in mask.mask_documents(stored)._jdf.queryExecution().executedPlan().toString()


def test_hot_document_is_ranked_and_counted(spark):
    rows = [(1, i, f"a{i % 40}@b.cc 555-000-{i % 300:04d}", "en") for i in range(1, 2500)] + [(2, 1, "x@y.zz", "en")]
    found = detect.findings(spark.createDataFrame(rows, PAGES), "redact", ["phone", "email"])
    first = collate.first_seen(found)
    got = {(r["doc_id"], r["category"], r["value"]): r["position"] for r in
           collate.ranked(first, ["doc_id", "category"], ["ordinal", "page", "match_no"], "position").collect()}
    want = {}
    for d, page, text, _ in rows:
        mail, *phone = text.split(" ", 1)
        for c, v in [("email", mail), *(("phone", p) for p in phone)]:
            want.setdefault((d, c, v), sum(1 for k in want if k[:2] == (d, c)) + 1)
    assert got == want
    counts = {(r["doc_id"], r["category"]): r["n_items"] for r in collate.category_counts(found).collect()}
    assert counts == {(1, "phone"): 300, (1, "email"): 2499, (2, "email"): 1}


def test_target_lists_of_large_documents_take_the_gram_path(spark):
    rows = [(1, i, f"card {4000000000000000 + 7 * i} and {4000000000000000 + 7 * (i + 50)}", "en") for i in range(1, 400)]
    pages = spark.createDataFrame(rows, PAGES)
    wanted = mask.targets(detect.findings(pages, "redact", ["credit_card"]))
    light = mask.mask_pages(pages, wanted, list_limit=10_000)
    heavy = mask.mask_pages(pages, wanted, list_limit=10)
    assert light.exceptAll(heavy).isEmpty() and heavy.filter(F.col("text").rlike(r"\d{16}")).isEmpty()


def test_regex_mask(spark):
    pages = spark.createDataFrame([(1, 1, "abc ABC xabc", "en"), (1, 2, "Summary abc", "en")], PAGES)
    def found(**kw):
        rows = detect.regex_mask(pages, r"\babc", **kw).collect()
        return sorted((r["page"], r["match"], r["start"], r["end"], r["mask"]) for r in rows)

    every = [(1, "ABC", 4, 7, "███"), (1, "abc", 0, 3, "███"), (2, "abc", 8, 11, "███")]
    assert found(preserve_headings=False) == every
    assert found() == every[1:]  # "ABC" looks like an all-caps heading
    assert detect.regex_mask(pages, "(").isEmpty()
    assert detect.regex_mask(pages, "x*", blur=True).collect()[0]["mask"] == "*"


def test_decode(spark):
    text = "Zeile eins\né ü."  # an odd number of bytes in ISO-8859-1: an even one would pass for UTF-16
    raw = [text.encode("utf-8"), text.encode("utf-16"), text.encode("latin-1"), text.replace("\n", "\r\n").encode(), b"\xfe\xff\x00a"]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "c binary").select(corpus.decode_content(F.col("c")))
    assert [r[0] for r in df.collect()] == [text, text, text, text, "a"]


def python_decode(raw, codecs):
    for name in codecs:
        try:
            return name, raw.decode(name).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            pass
    return None


@pytest.mark.parametrize("codecs", [corpus.CODECS, ("utf-8", "utf-16", "utf-16be", "ascii", "cp1252"), ("ascii",), ("utf-16le", "utf-16be")])
def test_decoding_ladder(spark, codecs):
    """Random bytes, cut texts, lone and swapped surrogates: the first codec that Python takes, or none."""
    rng, raw = random.Random(8), [b"", b"\xff", b"\xff\xfe", b"\xfe\xff", b"\x00\xd8", b"\xd8\x00\xdc\x00", b"\x00\xd8\x00\xdc", b"\x00\xdc\x00\xd8"]
    for _ in range(1500):
        text = "".join(rng.choice("ab é\n\rß€\U0001f600Ã©ऄ") for _ in range(rng.randint(0, 9)))
        made = rng.choice([b"", b"\xff\xfe", b"\xfe\xff"]) + text.encode(rng.choice(["utf-8", "utf-16le", "utf-16be", "utf-16"]))
        raw.append(made[: len(made) - rng.choice([0, 0, 0, 1, 2])] + rng.choice([b"", b"", b"\x81", b"\xd8\xdc"]))
        raw.append(bytes(rng.choice([0, 10, 65, 0x81, 0xC3, 0xA9, 0xD8, 0xDC, 0xFF, 0xFE]) for _ in range(rng.randint(0, 7))))
    raw.append("é".encode("utf-16le") * 200_000)
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, c binary").select("i", corpus.decoded(F.col("c"), codecs).alias("d")).collect()
    for r in rows:
        assert (r.d and (r.d.codec, r.d.text)) == python_decode(raw[r.i], codecs), raw[r.i][:40]


def test_files_that_are_not_wanted_stay_closed(spark, tmp_path):
    """Routes and sizes are judged on the listing: a pipe that would block a reader is listed and never opened."""
    (tmp_path / "a.txt").write_bytes(b"text")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.PDF").write_bytes(b"page")
    with (tmp_path / "big.pdf").open("wb") as f:
        f.truncate(corpus.MAX_UPLOAD_BYTES + 1)
    (tmp_path / "c.doc").write_bytes(b"other")
    listed = {r.name: (r.length, r.route, r.reject_reason) for r in corpus.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"a.txt": (4, "text", "not_pdf"), "b.PDF": (4, "page", None), "big.pdf": (corpus.MAX_UPLOAD_BYTES + 1, "page", "too_large"), "c.doc": (5, "page", "not_pdf")}
    assert [(r.name, bytes(r.content)) for r in corpus.admitted_files(spark, str(tmp_path), "text").collect()] == [("a.txt", b"text")]
    pages = corpus.admitted_files(spark, str(tmp_path), "page")
    assert [(r.name, bytes(r.content)) for r in pages.collect()] == [("b.PDF", b"page")]
    assert "LessThanOrEqual(length" in pages._jdf.queryExecution().executedPlan().toString()
    assert "content" not in corpus.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("a\r\nb".encode())
    (tmp_path / "b.TXT").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"no")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in corpus.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "a\nb", "b.TXT": "é"}


def test_options():
    with pytest.raises(ValueError):
        RedactOptions()
    with pytest.raises(ValueError):
        RedactOptions(mask="x", mask_counts=False)
    with pytest.raises(ValueError):
        RedactOptions(categories=("ssn",))
    assert RedactOptions(mask="x").enabled() == ["mask"]
    assert len(RedactOptions(all_categories=True).enabled()) == 9


def test_language_detection(spark):
    docs = corpus.whole_documents(spark, SMALL)
    found = language.detect_language(docs.drop("lang"), language.trained(docs.select("text", "lang")))
    wrong = found.join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id").filter("lang <> label").count()
    assert wrong <= 0.05 * docs.count()
    empty = spark.createDataFrame([(1, 1, "")], "doc_id bigint, page int, text string")
    assert language.detect_language(empty, language.trained(docs.select("text", "lang"))).collect()[0]["lang"] == "en"


def test_stream_equals_batch(spark, tmp_path):
    options = RedactOptions(all_categories=True, mask="the")
    source = redact_stream.document_stream(spark, SMALL, "documents.parquet")
    redact_stream.start_redaction(source, options, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(mask.mask_text(docs, mask="the")).isEmpty() and got.count() == docs.count()
    pages = corpus.split_pages(redact_stream.document_stream(spark, SMALL, "documents.parquet"))
    redact_stream.start_counts(pages, options, str(tmp_path / "n"), str(tmp_path / "cp2")).awaitTermination()
    want = collate.category_counts(detect.findings(corpus.split_pages(docs), "redact", options.enabled(), "the"))
    assert redact_stream.read_counts(spark, str(tmp_path / "n")).exceptAll(want).isEmpty()


def test_heading_forms_with_a_label_table(spark):
    lines = ["Phone: 1", "Phone 1", "Foo: x", "IV. Scope", "ALL CAPS", "see Section 4", "1. Intro", "Page 3", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, text string")
    words = spark.createDataFrame([("Phone",), ("Page",)], "word string")

    def forms(**kw):
        return [r["form"] for r in headings.classify_headings(df, **kw).orderBy("i").collect()]

    rest = ["roman", "all_caps", "section", "numbered"]
    assert forms() == ["label", "word_number", "label", *rest, "word_number", None]
    assert forms(label_words=words) == ["label", "label", "single_word", *rest, "label", None]


def test_language_of_pages_is_detected_for_auto(spark):
    docs = corpus.whole_documents(spark, SMALL)
    profile = language.trained(docs.select("text", "lang"))
    pages = docs.select("doc_id", "page", "text")
    auto = with_language(pages, RedactOptions(mask="x"), profile)
    assert auto.select("lang").distinct().count() == 4
    fixed = with_language(pages, RedactOptions(mask="x", language="hi"), profile)
    assert [r[0] for r in fixed.select("lang").distinct().collect()] == ["hi"]
