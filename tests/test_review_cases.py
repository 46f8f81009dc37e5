"""Cases that one corpus of test data does not hold: generated matches, long pages, odd masks, folders, split batches."""

import random
import re
import warnings

import pytest
from pyspark.sql import functions as F

from inkveil.functions import headings, validators
from inkveil.functions.patterns import Pattern, profile_patterns
from inkveil.operators import collate, detect, mask, verify
from inkveil.plans.options import RedactOptions
from inkveil.sources import session
from inkveil.streaming import redact_stream
from re import _parser

RNG = random.Random(0)


def sample(parsed, ignore_case):
    """A random text that the parsed regex matches, lookarounds aside."""
    out = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            c = chr(arg)
            out.append(RNG.choice([c.lower(), c.upper()]) if ignore_case else c)
        elif name == "IN":
            out.append(pick(arg))
        elif name == "ANY":
            out.append("x")
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out.append("".join(sample(inner, ignore_case) for _ in range(RNG.randint(low, min(int(high), low + 3)))))
        elif name == "SUBPATTERN":
            out.append(sample(arg[-1], ignore_case))
        elif name == "BRANCH":
            out.append(sample(RNG.choice(arg[1]), ignore_case))
        elif name == "CATEGORY":
            out.append(pick([(op, arg)]))
        elif name == "ASSERT":
            out.append(sample(arg[1], ignore_case))
        else:
            assert name in ("AT", "ASSERT_NOT"), name
    return "".join(out)


def pick(choices):
    op, arg = RNG.choice([c for c in choices if str(c[0]) != "NEGATE"])
    if str(op) == "RANGE":
        return chr(RNG.randint(*arg))
    if str(op) == "CATEGORY":
        return {"CATEGORY_DIGIT": RNG.choice("0123456789"), "CATEGORY_SPACE": RNG.choice(" \t "), "CATEGORY_WORD": RNG.choice("aZ9_")}[str(arg)]
    return chr(arg)


def every_pattern():
    for profile in ("redact", "scan", "strict", "text"):
        yield from ((profile, p) for p in profile_patterns(profile))
    yield from (("lang", p) for lang in ("en", "hi") for p in profile_patterns("lang", lang=lang))


def test_guards_hold_for_generated_matches(spark):
    """What Python finds in a generated text is found behind the guard as well, and seen by the verifier."""
    cases = []
    patterns = [p for _, p in every_pattern()]
    for i, p in enumerate(patterns):
        flags = re.IGNORECASE if p.ignore_case else 0
        for _ in range(40):
            text = RNG.choice(["", "x", "x ", "é, "]) + sample(_parser.parse(p.regex, flags), p.ignore_case) + RNG.choice(["", " y", "."])
            want = [m[0] for m in re.finditer(p.regex, text, flags)]
            if want:
                cases.append((i, text, want))
    assert len({i for i, *_ in cases}) > 0.9 * len(patterns)
    df = spark.createDataFrame(cases, "i int, text string, want array<string>").repartition(8)
    got = F.coalesce(*[F.when(F.col("i") == i, detect.guarded_matches(F.col("text"), p)) for i, p in enumerate(patterns)])
    missed = df.withColumn("got", got).where("got is null or got <> want").limit(5).collect()
    assert missed == []


def test_labelled_iban_of_letters(spark):
    pages = spark.createDataFrame([(1, 1, "IBAN: GB82WESTABCDEFGHIJ"), (2, 1, "iban mt84maltxyzabcdefgh")], "doc_id long, page int, text string")
    found = detect.findings(pages, "redact", ["iban"])
    assert found.count() == 2
    assert mask.mask_pages(pages, mask.targets(found)).where(F.col("text").contains("█")).count() == 2
    assert verify.leftover_matches(pages, profile_patterns("redact", ["iban"])).where("doc_id = 1").count() == 1


def test_long_runs_of_capitalised_words(spark):
    texts = ["Ab " * 350_000, "Ab " * 350_000 + ":", "A" * 1_000_000, "Ab Cd:", "Ab  Cd -", "Ab cd:", "AbCd E:", "Ab Cd", "A b:", "Ab\tCd\n:", "ABc Def :"]
    langs = ["en", "de", "fr", "es", "hi"]
    rows = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts) for lang in langs], "i int, text string, lang string")
    got = {(r.i, r.lang): r.h for r in rows.select("i", "lang", headings.is_heading(F.col("text"), F.col("lang")).alias("h")).collect()}
    for i, t in enumerate(texts[3:], 3):
        plain = any(re.search(p, t.strip()) for p in headings.COMMON_HEADINGS)
        assert got[i, "en"] == plain, t
    assert got[0, "en"] is False and got[1, "de"] is True


@pytest.mark.parametrize("limit", [1000, 0])
@pytest.mark.parametrize("blur", [True, False])
def test_one_masking_rule_for_all_ways(spark, limit, blur):
    """Targets on the original page are hidden, also when masks make or break others."""
    rng, char = random.Random(5), "*" if blur else "█"
    pieces = ["a", "b", "c", " ", "*", "█", "d"]
    pages = [(d, p, "".join(rng.choice(pieces) for _ in range(30))) for d in range(30) for p in (1, 2)]
    wanted, order = [], {}
    for d in range(30):
        for n in range(6):
            value = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))
            if value.strip() and value not in order.setdefault(d, []):
                order[d].append(value)
                wanted.append((d, 1, n, 1, 0, value, value, []))
    schema = "doc_id long, cat_no int, ordinal int, page int, match_no int, value string, hide string, kept_in array<string>"
    out = mask.mask_pages(spark.createDataFrame(pages, "doc_id long, page int, text string"), spark.createDataFrame(wanted, schema), blur, limit)
    got = {(r.doc_id, r.page): r.text for r in out.collect()}
    for d, p, text in pages:
        want = text
        for value in [v for v in order.get(d, []) if v in text]:
            want = want.replace(value, char * len(value))
        assert got[d, p] == want


def test_digits_of_all_scripts(spark):
    values = ["ABCPD१२३४E", "ABCPD1234E", "ABCPD𝟏𝟐𝟑𝟒E", "ABCXD1234E"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", validators.pan_valid(F.col("v")).alias("ok"))
    assert {r.v: r.ok for r in rows.collect()} == dict(zip(values, [True, True, True, False]))
    iban = spark.createDataFrame([("GB८२WEST12345698765432",), ("GB82WEST12345698765432",), ("GB83WEST12345698765432",)], "v string")
    assert [r.ok for r in iban.select(validators.iban_valid(F.col("v")).alias("ok")).collect()] == [True, True, False]


def test_user_regexes(spark):
    pages = spark.createDataFrame([(1, 1, "pay by card, card")], "doc_id long, page int, text string")
    assert detect.regex_mask(pages, r"(?P<my_x>card), (?P=my_x)").count() == 1
    with pytest.warns(UserWarning, match="not a valid"):
        assert detect.regex_mask(pages, "(card").count() == 0
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert detect.regex_mask(pages, "card").count() == 2


def test_pattern_table_of_any_length(spark):
    pages = spark.createDataFrame([(1, 1, "w7 w1104 w99999")], "doc_id long, page int, text string")
    table = spark.createDataFrame([(i, rf"\bw{i}\b", False) for i in range(1105)], "pattern_id int, regex string, ignore_case boolean")
    got = detect.match_pattern_table(pages, table, 300)
    assert sorted(r.pattern_id for r in got.collect()) == [7, 1104]


def test_stream_of_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    rows.repartition(4).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = redact_stream.document_stream(spark, str(tmp_path / "in"), "documents.parquet")
    redact_stream.start_redaction(stream, RedactOptions(all_categories=True), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 20


def test_stream_counts_a_value_of_two_batches_once(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "555-123-4567 a@b.co"), (1, 2, "555-123-4567 a@b.co")], "doc_id long, page int, text string")
    pages.repartitionByRange(2, "page").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    redact_stream.start_counts(stream, RedactOptions(all_categories=True), out, str(tmp_path / "state")).awaitTermination()
    got = {(r.category, r.n_items) for r in redact_stream.read_counts(spark, out).collect()}
    want = {(r.category, r.n_items) for r in collate.category_counts(detect.findings(pages, "redact")).collect()}
    assert got == want == {("phone", 1), ("email", 2)}


class Settings:
    """A session with no shared folder, on the given master."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master = self, self, master

    def get(self, key, default=None):
        return default


def test_work_folder_on_a_cluster():
    with pytest.raises(ValueError):
        session.shared_dir(Settings("spark://host:7077"), "x")
    with pytest.raises(ValueError):
        session.shared_dir(Settings("local-cluster[2,1,1024]"), "x")
    assert "x-" in session.shared_dir(Settings("local[4]"), "x")


def test_released_tables_are_gone(spark):
    kept = list(session.WORK_FOLDERS)
    session.WORK_FOLDERS.clear()
    try:
        stored = session.materialise(spark.range(5), "five")
        assert stored.count() == 5
        [path] = session.WORK_FOLDERS
        session.release(spark)
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        there = jvm.Path(path)
        assert not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    finally:
        session.WORK_FOLDERS.extend(kept)


def test_pattern_guard_is_a_field():
    assert Pattern("iban", 1, 2, r"\bIBAN\s*:?\s*[A-Z]{2}[0-9]{2}[0-9A-Z]{10,30}\b").guard == "digits2"
