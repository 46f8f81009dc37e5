"""Replacing many values at once gives the text that replacing value by value gives, and stays about linear."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from inkveil.functions import replacing
from inkveil.operators import mask

SCHEMA = "doc_id long, text string"
HIDE = {"token": (lambda v: "[tok]", lambda v: F.lit("[tok]")), "block": (lambda v: "█" * len(v), lambda v: F.repeat(F.lit("█"), F.length(v)))}


@pytest.mark.parametrize("few", [0, 8])
@pytest.mark.parametrize("kind", list(HIDE))
def test_replacing_at_once_is_replacing_in_order(spark, monkeypatch, few, kind):
    monkeypatch.setattr(replacing, "FEW", few)
    rng, rows = random.Random(few), []
    for _ in range(1200):
        alphabet = rng.choice(["ab", "abc", "0123456789", "a\\E.Q", "(a)|$", "éß1\U0001f600", "a\n\x00"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80)))
        places = [(a, a + rng.choice([1, 2, 3, 4, 13, 14, 20])) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 25)))]
        rows.append((text, list(dict.fromkeys(text[a:b] for a, b in places))))
    rows.append((None, ["a"]))
    own, native = HIDE[kind]
    masked = replacing.replace_in_order(F.col("text"), F.col("vs"), native)
    free = F.when(F.size("vs") > 0, F.size(F.array_except("vs", replacing.entangled(F.col("text"), F.col("vs"), replacing.one_of(F.col("vs"))))))
    got = spark.createDataFrame(rows, "text string, vs array<string>").select("text", "vs", masked.alias("m"), free.alias("free")).collect()
    for r in got:
        want = r.text
        for v in r.vs if want else []:
            want = want.replace(v, own(v))
        assert r.m == want, r
    assert sum((r.free or 0) > 0 for r in got) > 100  # values that need no turn of their own


def test_longest_value_at_a_place(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        text = "".join(rng.choice("ab") for _ in range(60))
        rows.append((text, list({text[a : a + rng.choice([1, 2, 5, 12, 13, 15])] for a in rng.choices(range(45), k=rng.randint(1, 12))})))
    longest = F.regexp_extract_all("text", F.concat(F.lit("(?=("), replacing.one_of(F.col("vs")), F.lit("))")), F.lit(1))
    for r in spark.createDataFrame(rows, "text string, vs array<string>").select("text", "vs", longest.alias("m")).collect():
        want = [max(here, key=len) for i in range(len(r.text)) if (here := [v for v in r.vs if r.text.startswith(v, i)])]
        assert r.m == want


def busy_text(rng, n):
    parts = [lambda: f"555-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", lambda: f"a{rng.randint(0, 99)}@b.co", lambda: f"{rng.randint(10**15, 10**16 - 1)}",
             lambda: f"x{rng.randint(0, 9)} [at] y", lambda: "the end", lambda: f"1{rng.randint(100, 999)} {rng.randint(10, 99)}", lambda: "me[at]b[dot]co", lambda: "٤٥٦ 1234² é"]
    return rng.choice(["\n", " "]).join(rng.choice(parts)() for _ in range(n))


def test_both_ways_of_the_text_job(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, busy_text(rng, 60)) for i in range(40)] + [(99, None), (98, "")], SCHEMA)
    monkeypatch.setattr(replacing, "FEW", 10**6)
    in_turn = {r.doc_id: r for r in mask.mask_text(docs, mask="the", items=True).collect()}
    monkeypatch.setattr(replacing, "FEW", 0)
    assert {r.doc_id: r for r in mask.mask_text(docs, mask="the", items=True).collect()} == in_turn


@pytest.mark.parametrize("blur", [True, False])
def test_both_ways_of_documents_in_a_row(spark, monkeypatch, blur):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, busy_text(rng, 40) + "\nCVV: 123\nExpiry: 05/26 * █") for i in range(30)] + [(99, None), (98, "")], SCHEMA)
    monkeypatch.setattr(replacing, "FEW", 10**6)
    in_turn = {r.doc_id: r.text for r in mask.mask_documents(docs, mask="the", blur=blur).collect()}
    monkeypatch.setattr(replacing, "FEW", 0)
    assert {r.doc_id: r.text for r in mask.mask_documents(docs, mask="the", blur=blur).collect()} == in_turn


def test_no_python_worker(spark):
    docs = spark.createDataFrame([(1, "a")], SCHEMA)
    for out in (mask.mask_text(docs), mask.mask_documents(docs)):
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("way", ["text", "document"])
def test_texts_full_of_values_take_about_linear_time(spark, way):
    took = []
    for n in (10_000, 10_000, 40_000):
        text = "\n".join(f"Phone: 555-{i // 10000:03d}-{i % 10000:04d}" for i in range(n))
        docs = spark.createDataFrame([(1, text)], SCHEMA)
        started = time.time()
        out = (mask.mask_text if way == "text" else mask.mask_documents)(docs).select("text").first()[0]
        took.append(time.time() - started)
        assert not re.search(r"\d{3}", out)
    assert took[2] < 8 * took[1] + 5, took


def test_folded_values_listed_or_as_a_trie_hide_the_same(spark):
    """Few values are written short, for the breaks that a text can hold; the text is that of the trie with all breaks."""
    rng, rows = random.Random(7), []
    for i in range(1500):
        alphabet = rng.choice(["ab5- \n", "ab|[]\\E.+ \n", "aB\t\r\n5 -", "5-|\n ", "éÉßſıİK  \n", "ab5\x02\x03 \n", "Ab5 (x)", "a\U0001f600 \nQE\\", "a\x01b \n"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50)))
        values = [text[a : a + rng.choice([1, 2, 3, 5, 14])] for a in rng.choices(range(len(text)), k=rng.randint(1, 40 if i % 20 == 0 else 6))]
        rows.append((text, values))
    rows += [("CVV: 1\n23 x", ["CVV: 123"]), ("a\tb 5-\r\n 5", ["a b", "55"]), (None, ["a"])]
    pages = spark.createDataFrame(rows, "text string, given array<string>")
    pages = pages.select("text", F.filter(F.array_distinct(F.transform("given", replacing.folded)), lambda v: v != "").alias("vs")).where("size(vs) > 0")
    short = replacing.one_of_folded(F.col("text"), F.col("vs"))
    got = pages.select("text", "vs", replacing.cover(F.col("text"), short, "*").alias("a"), replacing.cover(F.col("text"), replacing.one_of(F.col("vs"), broken=True), "*").alias("b"),
                       F.length(short).alias("n")).collect()
    assert len(got) > 1400 and sum(r.a != r.text for r in got if r.text) > 1200
    for r in got:
        assert r.a == r.b, r
    assert [r.a for r in got if r.vs in (["cvv: 123"], ["a b", "55"])] == ["******\n** x", "*** **\r\n**"]
    one = spark.createDataFrame([("x 5551234567", ["5551234567"]), ("x\n5551234567", ["5551234567"])], "text string, vs array<string>")
    assert [r.n for r in one.select(F.length(replacing.one_of_folded(F.col("text"), F.col("vs"))).alias("n")).collect()] == [19, 190]
