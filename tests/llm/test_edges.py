"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import pytest

import corpus_pipeline
from inkveil.llm import decontam, langid, licenses, packing, personal, secrets, sharding, simhash, spotsigs, tokens, urls

CLASHES = (
    "_found _fp _language _doc_id _blob _spans _hit _words _salt k r fp fp2 id blob root mask key size shard slot spans kinds score "
    "range at host path rule verdict cluster uid g u v"
).split()
LONG = "wordy text of some length, then more. " * 8000
ROWS = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, "the cat sat on the mat", "en", "a", 22), (3, "the cat sat on the mat", "en", "a", 22),
    (4, "the cat sat on the mat", "en", "b", 22), (None, "no id here, password=abcdefghijklmnop", "en", None, 5), (None, None, None, None, None),
    (5, LONG, "en", "a", len(LONG)), (6, "\U0001f600 ünïcode  \t\n x", "de", "c", 14), (7, "!!! ... 123", "xx", "c", 11), (-8, "token: " + "z" * 40, "en", "a", 47),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS, clashes=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'{c}' as {c}" for c in CLASHES]) if clashes else df


def bench(spark, rows=None):
    given = [(1, "the cat sat"), (2, None), (3, ""), (None, "mat"), (1, "the cat sat")] if rows is None else rows
    return spark.createDataFrame(given, "item_id long, text string")


def path_of():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


OPERATORS = {
    "secrets": lambda s, d: secrets.scan_documents(d),
    "secrets_masked": lambda s, d: secrets.mask_secrets(d),
    "licenses": lambda s, d: licenses.scan(d),
    "spotsigs": lambda s, d: spotsigs.fingerprints(d),
    "packing": lambda s, d: packing.pack(d, capacity=100_000),
    "langid": lambda s, d: langid.identify(d),
    "simhash": lambda s, d: simhash.near_groups(d),
    "tokens": lambda s, d: tokens.round_trip(d, path_of()),
    "personal": lambda s, d: personal.scan(d.drop("_found")),
    "sharding": lambda s, d: sharding.shard(d),
    "decontam": lambda s, d: decontam.contamination(d, bench(s)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_keep_their_number(spark, name):
    rows = OPERATORS[name](spark, documents(spark)).collect()
    assert len(rows) == len(ROWS)
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
    assert ids == sorted((r[0] is not None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
@pytest.mark.parametrize("rows", [ROWS, []])
def test_stage_keeps_the_columns(spark, tmp_path, name, stage, rows):
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, rows)
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    kept = out.collect()
    texts = [r.text for r in kept]
    if not rows:
        assert kept == []
    elif name == "language_id":
        assert None not in texts and "" not in texts and "!!! ... 123" not in texts and LONG in texts
    elif name == "simhash_dedup":
        known = [r for r in kept if r.doc_id is not None]
        assert sorted(r.doc_id for r in known) == [-8, 1, 3, 5, 6, 7] and len(kept) == 8
    elif name == "decontamination":
        assert sum(t is not None and "mat" in t.split() for t in texts) == 0 and LONG in texts
    else:
        assert len(kept) == len(rows)
        assert sorted(t for t in texts if t and "REDACTED" in t) == ["[REDACTED]", "no id here, [REDACTED]"]
        assert all(r.n_chars == len(r.text) for r in kept if r.text and "REDACTED" in r.text)
    assert all(r.r == "r" and r.blob == "blob" for r in kept)


def test_empty_benchmark_and_rules(spark):
    docs = documents(spark, clashes=False)
    rows = decontam.contamination(docs, bench(spark, [])).collect()
    assert all(not r._found.hits for r in rows) and len(rows) == len(ROWS)
    pages = spark.createDataFrame([(1, "http://A.org/x?q"), (2, None), (3, "no scheme")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, verdict string")
    assert [(r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, none).orderBy("page_id").collect()] == [
        ("a.org", "/x", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow")]


def test_defined_results(spark):
    docs = documents(spark, clashes=False)
    marks = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    assert marks[1].fp == 0 and marks[1].component_id == 1 and marks[2].component_id == 1 and marks[4].component_id == 3
    assert marks[None].component_id is None
    said = {(r.doc_id, r.text): r._language for r in langid.identify(docs).collect()}
    assert said[(1, None)].lang_pred == "und" and said[(7, "!!! ... 123")].lang_pred == "und" and said[(5, LONG)].lang_pred in ("en", "de", "xx")
    prints = {r.doc_id: r for r in spotsigs.fingerprints(docs).where("doc_id is not null").collect()}
    assert prints[1].fingerprint == prints[2].fingerprint == "" and prints[3].fingerprint == prints[4].fingerprint != ""
    packed = packing.pack(docs, capacity=10).collect()
    assert sum(r.size for r in packed) == sum(len((t or "").split()) + 1 for _, t, *_ in ROWS)
    assert max(r.size for r in packed) <= 10
