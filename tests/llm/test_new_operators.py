"""Personal data, ranked search and collocations against plain renderings of their definitions."""

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkveil.llm import bitmaps, collocations, crf, lexical, personal

DOCS = "doc_id long, text string, lang string"


# --- filters ---


def test_filter_holds_all_and_little_else(spark):
    words = [f"w{i}" for i in range(3000)]
    bits = bitmaps.gather(spark.createDataFrame([(w,) for w in words], "w string"), ["w"], lambda w: bitmaps.hashes(x.encode() for x in w), 18)
    assert bits.size == 2**15 and bitmaps.has(bits, bitmaps.hashes(w.encode() for w in words)).all()
    assert bitmaps.has(bits, bitmaps.hashes(f"x{i}".encode() for i in range(3000))).mean() < 0.03
    with pytest.raises(ValueError):
        bitmaps.empty(40)


# --- personal data ---

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            fits = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn,
                    "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((k, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(3)
    parts = ["@", ".", "a", "bc-d", "x.y", "+", "%", "1", "25", "256", "0004", "-", " ", "  ", "(", ")", "4111111111111111", "4111 1111", "+49 30 1234567", "é", "\n", "²", "٣", "10.0.0.1", "a@b.c", "\U0001f600"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert personal.base_spans(text) == plain_spans(text), text


def test_base_spans_of_long_runs_take_linear_time():
    started = time.time()
    for unit in ("a", "1", "1.", "+", "a@", "1 ", "-", "+1(", "@a", "a.", "0"):
        personal.base_spans(unit * 300_000)
    assert time.time() - started < 20


@pytest.fixture(scope="module")
def model(spark):
    return personal.train(personal.labelled_table(spark))


def test_field_against_all_paths(model):
    """Likelihood, expected counts and Viterbi against the enumeration of every path of short sequences."""
    rng = random.Random(4)
    words = ["call", "+", "1", "4111111111111111", "at", "dot", "@", "(", "555", "zzz", "."]
    for _ in range(12):
        n = rng.randint(1, 4)
        codes = np.array([[model.class_of(rng.choice(words)) for _ in range(n)]])
        glued = np.array([[False] + [rng.random() < 0.5 for _ in range(n - 1)]])
        e = crf.emissions(model, codes, glued)[0]
        paths = list(itertools.product(range(crf.LABELS), repeat=n))
        scores = np.array([sum(e[t, y] + (model.moves[-1, y] if t == 0 else model.moves[p[t - 1], y]) for t, y in enumerate(p)) for p in paths])
        total = scores.max() + math.log(np.exp(scores - scores.max()).sum())
        path = paths[int(scores.argmax())]
        assert crf.decode(model, [(codes[0].tolist(), glued[0].tolist())])[0].tolist() == list(path)
        assert crf.likelihood(model, codes, glued, np.array([path])) == pytest.approx(scores.max() - total)
        place, move = crf._expected(crf.emissions(model, codes, glued), model.moves, np.ones(codes.shape, dtype=bool))
        weight = np.exp(scores - total)
        for t in range(n):
            assert place[0, t] == pytest.approx([weight[[p[t] == y for p in paths]].sum() for y in range(crf.LABELS)], abs=1e-9)
        assert move.sum() == pytest.approx(n)


def test_field_learns_its_table_and_more(spark, model):
    finder = personal.Finder(model)
    for line in personal.LABELLED:
        text, spans = personal.marked(line)
        base, added = finder([text])[0]
        found = {(b, e) for _, b, e in [*base, *added]}
        assert {(b, e) for b, e, _ in spans} <= found | {(b, e) for b, e, k in spans if not personal.holds(personal.KINDS.index(k), text[b:e])}, line
    unseen = {
        "so write to karl at firma dot de now": ("email", "karl at firma dot de"), "sent from 10[.]99[.]2[.]3 then": ("ip", "10[.]99[.]2[.]3"),
        "was +1 (199) 555-1234 10.3.4.5 here": ("phone", "+1 (199) 555-1234"), "the 4485275742308327 4539578763621486 of": ("card", "4539578763621486"),
    }
    for text, (kind, value) in unseen.items():
        assert (personal.KINDS.index(kind), text.index(value), text.index(value) + len(value)) in finder([text])[0][1], text
    clean = ["He came at 5. Dot was at home.", "Licensed under CC BY 4.0.", "In 1848, 300 of 1000 people 2024-11-30.", "key 04dbebab91ab85687d33eeaaf9ac699e", "x" * 5000 + " 12 at dot", ""]
    assert all(not a and not b for b, a in finder(clean))


def test_labelled_table_is_bounded(spark):
    rows = personal.labelled_table(spark)
    with pytest.raises(ValueError):
        personal.train(rows, most=5)
    with pytest.raises(ValueError):
        personal.train(rows.limit(0))


def test_scan_rows(spark, model):
    rows = [(1, None, "en"), (2, "", None), (None, "mail a@b.co 10.0.0.1", "en"), (2, "é😀 4111111111111111\n" + "word " * 3000 + "+1 (199) 555-1234 10.3.4.5", "en")]
    got = personal.scan(spark.createDataFrame(rows, DOCS), model).select("doc_id", "text", personal.listed(personal.ordered("_found.base", "_found.added")).alias("s")).collect()
    said = {(r.doc_id, r.text): r.s for r in got}
    assert said[(1, None)] == said[(2, "")] == "" and said[(None, rows[2][1])] == "email:5:11,ip:12:20"
    text = rows[3][1]
    at = text.index("+1")
    assert said[(2, text)] == f"ip:{at + 18}:{at + 26},card:3:19,phone:{at}:{at + 17}"
    assert personal.scan(spark.createDataFrame([], DOCS), model).collect() == []


# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, top):
    counts = [(d, Counter(TERM.findall((t or "").translate(LOWERED)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for row, (d, c) in enumerate(counts):
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(TERM.findall((text or "").translate(LOWERED))) if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0, row))
        out += [(item, rank, d if known else None, -s) for rank, (s, known, d, _) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize("seed,top", [(1, 3), (2, 50)])
def test_search(spark, seed, top):
    rng = random.Random(seed)
    words = [w for i in range(60) for w in [rng.choice(["", "É", "x1", "Zz"]) + f"w{i}"] * (1 + 300 // (i + 1) ** 2)]
    text = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(words) for _ in range(n))
    docs = [(rng.choice([None, i, i, 7]), rng.choice([None, "", "!", text(rng.randint(1, 60)), text(rng.randint(1, 60))])) for i in range(400)]
    items = [(rng.choice([None, i, 3]), rng.choice([None, "?", text(4), text(12)])) for i in range(25)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in lexical.search(d, b, top, power=15, block=16, bundle=4).collect()]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(plain_search(docs, items, top), key=key)


def test_search_of_nothing(spark):
    some, none = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, rank string"), spark.createDataFrame([], "doc_id long, text string")
    items, no_items = spark.createDataFrame([(1, "a"), (2, "zz")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(none, items, power=15).collect() == [] and lexical.search(some, no_items, power=15).collect() == []
    assert [tuple(r) for r in lexical.search(some, items, power=15).collect()] == plain_search([(1, "a b")], [(1, "a"), (2, "zz")], 50)


# --- collocations ---


def plain_collocations(docs, least, longest, covered=80):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: n for p, n in counts.items() if len(p) > 1 and n >= least}
        for p, a in often.items():
            inside = any(100 * n >= covered * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in often.items())
            if not inside:
                score, _, l, r = min((2000000 * a // (counts[p[:c]] + counts[p[c:]]), c, counts[p[:c]], counts[p[c:]]) for c in range(1, len(p)))
                out.append((lang, " ".join(p), a, l, r, total[lang], score))
    return out


@pytest.mark.parametrize("share,sample_least,power", [(4, 3, 27), (40, 2, 18), (1_000_000, 1, 15), (1, 1, 15)])
def test_collocations(spark, share, sample_least, power):
    """Samples that propose much, little, nothing and everything; filters that let much through by chance."""
    rng = random.Random(share)
    words = ["the", "The", "of", "é", "\x00", "a-b", "x\x1cy", "ÀB", "q", "r", "s", "t"]
    fixed = ["one two three four five", "of the of the of the", "rare pair"]
    docs = []
    for i in range(300):
        text = "".join(rng.choice([*words, rng.choice(fixed)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\r\n", ","]) for _ in range(rng.randint(0, 25)))
        docs.append((rng.choice([i, None, 5]), rng.choice([None, "", text, text, text, text]), rng.choice([None, "und", "en", "en", ""])))
    rows = collocations.collocations(spark.createDataFrame(docs, DOCS), 8, 4, share=share, sample_least=sample_least, power=power)
    assert sorted(tuple(r) for r in rows.select("lang", "phrase", "a", "l", "r", "n", "score").collect()) == sorted(plain_collocations(docs, 8, 4))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS), power=15).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, " .\n", "en")], DOCS), power=15).collect() == []


def test_exact_scores_beyond_64_bits(spark):
    """Counts near 2**63 keep their exact score."""
    big = 2**62
    got = spark.sql(f"select (cast(2000000 as decimal(7,0)) * cast({big} as decimal(19,0))) div (cast({big} as decimal(19,0)) + cast({big + 7} as decimal(19,0))) as s").first().s
    assert got == 2000000 * big // (2 * big + 7)
