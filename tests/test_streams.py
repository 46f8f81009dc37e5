"""Streams give what the batch job gives for any split into micro-batches; compactions lose and double nothing."""

import random

import pytest

from inkveil.operators import collate, detect, mask
from inkveil.plans.options import RedactOptions
from inkveil.plans.pipelines import redact_pages
from inkveil.streaming import generations, page_stream, redact_stream

OPTIONS = RedactOptions(all_categories=True, mask="the")
PAGES = "doc_id long, page int, text string, lang string"


def some_pages(rng):
    parts = ["555-123-4567", "a@b.co", "x a@b.co y", "4111 1111 1111 1111", "1111 1111", "CVV: 123", "123", "the end", "Summary", "IBAN: GB29NWBK60161331926819", "ABCFE1234F", "Name: 555-123-4567", "é", ""]
    return [(d, p, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 4))), rng.choice(["en", "de", "hi", None])) for d in range(12) for p in range(1, 6)]


@pytest.mark.parametrize("seed", [1])
def test_pages_of_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = some_pages(rng)
    want = {(r.doc_id, r.page): r.text for r in redact_pages(spark.createDataFrame(rows, PAGES), OPTIONS).collect()}
    rng.shuffle(rows)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(0, len(rows), 20):  # the query is stopped and started again between batches
        spark.createDataFrame(rows[i : i + 20], PAGES).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        page_stream.start_pages(source, OPTIONS, out, state).awaitTermination()
    got = {(r.doc_id, r.page): r.text for r in page_stream.read_pages(spark, out).collect()}
    assert got == want
    assert spark.read.parquet(out).count() > len(rows)  # earlier pages came again


def test_targets_of_a_page_are_those_of_the_batch_job(spark):
    pages = spark.createDataFrame(some_pages(random.Random(3)), PAGES)
    wanted = mask.targets(detect.findings(pages, "redact", OPTIONS.enabled(), OPTIONS.mask))
    want = {(r.doc_id, r.value, r.cat_no, r.ordinal, r.page, r.match_no, r.hide, tuple(r.kept_in)) for r in wanted.collect()}
    got = {}
    for r in page_stream.page_targets(pages, OPTIONS).collect():
        for h in r.hits:
            key = (r.doc_id, h.value)
            got[key] = min(got.get(key, (9e9,)), (h.cat_no, h.ordinal, h.page, h.match_no, h.hide, tuple(h.kept_in)))
    assert {(*k, *v) for k, v in got.items()} == want


def batch(spark, out, no, rows):
    spark.createDataFrame(rows, generations.VALUES).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={no}")


def counts(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("fan", [2, 4])
def test_compaction(spark, tmp_path, fan):
    rng, out, rows = random.Random(fan), str(tmp_path / "out"), []
    assert generations.read(spark, out).collect() == [] and not generations.compact(spark, out, fan)
    for no in range(12):
        new = [(rng.randint(1, 6), rng.choice(["phone", "email"]), rng.choice("abcd"), rng.randint(1, 3)) for _ in range(5)]
        batch(spark, out, no, new)
        if rng.random() < 0.4:
            batch(spark, out, no, new)  # repeated after a failure
        rows += new
        if rng.random() < 0.7:
            generations.compact(spark, out, fan)
        want = counts(collate.merged_counts(spark.createDataFrame(rows, generations.VALUES)))
        assert counts(redact_stream.read_counts(spark, out)) == want
    generations.clean(spark, out)
    assert counts(redact_stream.read_counts(spark, out)) == want


def test_a_compaction_that_ends_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    for no in range(4):
        batch(spark, out, no, [(1, "email", "a", 1), (no, "phone", "b", 2)])
    want = counts(generations.read(spark, out))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(generations._Folder, "put", broken)
        with pytest.raises(RuntimeError):
            generations.compact(spark, out)
    assert counts(generations.read(spark, out)) == want
    assert generations.compact(spark, out) and counts(generations.read(spark, out)) == want
    with pytest.raises(RuntimeError):  # two compactions at once: the second one does not take effect
        generations._Folder(spark, out).put("_generations/1.json", "{}")
    (tmp_path / "out" / "batch=9").mkdir()  # a batch that is being written
    assert counts(generations.read(spark, out)) == want


def test_reading_takes_open_batches_and_generations_only(spark, tmp_path):
    out = str(tmp_path / "out")
    for no in range(6):
        batch(spark, out, no, [(no, "phone", "b", 1)])
    generations.compact(spark, out)
    files = generations.read(spark, out).inputFiles()
    assert not any("batch=0" in f or "batch=4" in f for f in files) and any("batch=5" in f for f in files)
