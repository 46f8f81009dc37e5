"""Phrase collocations by Toivonen's sampling method.

Phrases are runs of two to four words inside a piece of text; per language those with at least ``least`` occurrences are
candidates.  A phrase is frequent only if the phrases without its first and without its last word are, so:

1. a sample of documents (a hash share of them) is mined level by level with a lowered threshold: it proposes phrases;
2. one pass over all documents counts the proposed phrases and their negative border (phrases that are not proposed while
   both phrases one word shorter are).  Words and proposed phrases are counted as they are, the border, which is by far larger
   and nearly all rare, by 64-bit hashes: one that does not reach ``least`` stands for no frequent phrase;
3. what reaches it without having been proposed are border failures: their extensions have not been counted.  A further pass
   counts the phrases of these hashes exactly, as they are, and with them what the pass before left out.  A phrase first
   counted there is extended in the same pass, whatever its count will be, so the result is closed after it.  Without failures
   there is no such pass.

Tasks know the proposed phrases and the hashes that reached ``least`` as filters of fixed size (:mod:`.bitmaps`).  What a
filter lets through by chance is counted too and does no harm; the counts that are returned are sums of exact strings.  A batch
of some million characters is counted with integer codes of its own words and sends one row for each distinct phrase; Spark
sums these, combined map side, so a word that makes up a third of the corpus is one row a batch.  Parts of phrases are looked
up by salted joins.

Nulls and odd input: a null text is empty, a null language is ``und``; documents count as often as they stand in the table;
null and repeated doc_ids are documents like any other; empty texts and an empty table give no phrases; a text of any length
is one batch; all columns but doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm import bitmaps
from inkveil.llm.common import LOWER, UPPER, numbered, python_tasks
from inkveil.sources.session import materialise

UND = "und"
#: One document in so many is in the sample; a phrase is proposed from so many occurrences there on.
SHARE, SAMPLE_LEAST = 4, 6
#: Characters counted at once.
CHUNK = 8_000_000
SALTS = 16

_END = b"\xff"  # stands in no UTF-8 text
_TABLE = bytes.maketrans((UPPER + ".,;:!?\n\x0b\x0c\r\t").encode(), LOWER.encode() + _END * 10 + b" ")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
COUNTS = "lang string, k int, phrase string, n long"


def _codes(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """All words of the texts in order as codes (0 ends a piece), and the word of each code."""
    return numbered(_END.join(texts).translate(_TABLE).replace(_END, b" " + _END + b" ").split(), _END)


def _extend(marks: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Hashes of phrases, each one word longer than ``marks``."""
    with np.errstate(over="ignore"):
        out = (marks * _STEP + nexts) * _MIX
    return out ^ (out >> np.uint64(31))


def _first(lang: str, words: np.ndarray) -> np.ndarray:
    return _extend(np.full(len(words), bitmaps.hashes([lang.encode()], 1)[0]), words)


def _grown(lang: str, codes: np.ndarray, words: list[bytes], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k = 1 to ``longest``: whether a phrase of k words begins at each place, and its hash."""
    single = bitmaps.hashes(words)[codes]
    whole, marks = codes > 0, _first(lang, single)
    yield 1, whole, marks
    for k in range(2, longest + 1):
        whole, marks = whole[:-1] & (codes[k - 1 :] > 0), _extend(marks[:-1], single[k - 1 :])
        yield k, whole, marks


def _inside(places: np.ndarray, bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Those of ``places`` whose hash ``bits`` hold."""
    out = np.zeros(len(places), dtype=bool)
    at = np.flatnonzero(places)
    out[at] = bitmaps.has(bits, marks[at])
    return out


def _both(whole: np.ndarray, passes: np.ndarray | None) -> np.ndarray:
    return whole if passes is None else whole & passes[:-1] & passes[1:]


def _told(codes: np.ndarray, words: list[bytes], label: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of k words at the places ``at``: a code for each place, a place of each phrase, its count, and the new labels.

    ``label`` has codes of the phrases one word shorter; with the last word they give exact codes.
    """
    known, first, inverse, n = np.unique(label[:-1][at] * len(words) + codes[k - 1 :][at], return_index=True, return_inverse=True, return_counts=True)
    out = np.zeros(len(codes) - k + 1, dtype=np.int64)
    out[at] = inverse
    return inverse, at[first], n, out


def _phrases(codes: np.ndarray, words: list[bytes], places: np.ndarray, k: int) -> list[str]:
    return [b" ".join([words[c] for c in row]).decode() for row in np.column_stack([codes[places + i] for i in range(k)]).tolist()] if len(places) else []


def border_chunk(lang: str, texts: list[bytes], longest: int, before: np.ndarray | None, now: np.ndarray, whole_pass: bool) -> Iterator[tuple]:
    """(phrases or None, hashes, counts) of the phrases whose two shorter ones are in ``now``, but for those that ``before`` counted.

    ``whole_pass``: words, and longer phrases that are in ``now`` themselves, come as they are, with the number of words as the
    phrase without a word; all others as hashes.
    """
    codes, words = _codes(texts)
    if whole_pass:
        yield [""], np.zeros(1, dtype=np.uint64), np.array([int((codes > 0).sum())])
    passes = passes_before = None
    label = codes
    for k, whole, marks in _grown(lang, codes, words, longest):
        counted = _both(whole, passes)
        fresh = counted
        if before is not None:
            counted_before = _both(whole, passes_before)
            fresh = counted & ~counted_before
        if not counted.any():
            return
        passes = _inside(counted, now, marks)
        if not whole_pass:
            yield None, *np.unique(marks[fresh], return_counts=True)
        elif k == 1:
            n = np.bincount(codes, minlength=len(words))[1:]
            yield [w.decode() for w in words[1:]], _first(lang, bitmaps.hashes(words[1:])), n
        else:
            yield None, *np.unique(marks[counted & ~passes], return_counts=True)
            _, places, n, label = _told(codes, words, label, np.flatnonzero(passes), k)
            yield _phrases(codes, words, places, k), marks[places], n
        if before is not None:
            passes_before = _inside(counted_before, before, marks)


def failure_chunk(lang: str, texts: list[bytes], longest: int, before: np.ndarray, known: np.ndarray) -> Iterator[tuple]:
    """(k, phrases, counts) of all phrases that may be frequent and that the whole pass did not count as they are.

    ``before`` are the proposed phrases, so that it is known what that pass counted; ``known`` holds the frequent ones of these
    and the hashes that reached the threshold.  A phrase that it did not count is counted here and extended, whatever its count
    will be.
    """
    codes, words = _codes(texts)
    label = codes
    passes = passes_before = None
    for k, whole, marks in _grown(lang, codes, words, longest):
        counted, counted_before = _both(whole, passes), _both(whole, passes_before)
        passes, proposed = _inside(counted, known, marks), _inside(counted_before, before, marks)
        if k > 1:
            passes |= counted & ~counted_before
            at = np.flatnonzero(passes)
            if not len(at):
                return
            inverse, places, n, label = _told(codes, words, label, at, k)
            told = ~proposed[places]
            yield k, _phrases(codes, words, places[told], k), n[told]
        passes_before = proposed


def _by_language(held, chunk, frame):
    """A function over batches: texts of a language are gathered to chunks; ``chunk`` and ``frame`` make their rows."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pd.DataFrame]:
            sizes.pop(lang)
            for found in chunk(lang, waiting.pop(lang), *held.value):
                n = len(found[-1])
                for i in range(0, n, 100_000):
                    yield frame(lang, found, slice(i, i + 100_000))

        for part in parts:
            for lang, text in zip(part["lang"], part["text"]):
                waiting.setdefault(lang, []).append(text.encode())
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] > CHUNK:
                    yield from flush(lang)
        for lang in list(waiting):
            yield from flush(lang)

    return run


def border_pass(docs: DataFrame, longest: int, before: np.ndarray | None, now: np.ndarray, whole_pass: bool) -> DataFrame:
    """One pass over ``docs(lang, text)``: (lang, phrase, mark, n), language and phrase of what is counted as it is."""
    def frame(lang, found, part):
        phrases, marks, n = found
        marks = marks[part].view(np.int64)
        return pd.DataFrame({"lang": None if phrases is None else lang, "phrase": [None] * len(marks) if phrases is None else phrases[part], "mark": marks, "n": n[part]})

    held = docs.sparkSession.sparkContext.broadcast((longest, before, now, whole_pass))
    rows = docs.select("lang", "text").mapInPandas(_by_language(held, border_chunk, frame), "lang string, phrase string, mark long, n long")
    return rows.groupBy("lang", "phrase", "mark").agg(F.sum("n").alias("n"))


def failure_pass(docs: DataFrame, longest: int, before: np.ndarray, known: np.ndarray) -> DataFrame:
    """One pass over ``docs(lang, text)``: exact counts (lang, k, phrase, n) of what :func:`failure_chunk` counts."""
    def frame(lang, found, part):
        k, phrases, n = found
        return pd.DataFrame({"lang": lang, "k": k, "phrase": phrases[part], "n": n[part]})

    held = docs.sparkSession.sparkContext.broadcast((longest, before, known))
    rows = docs.select("lang", "text").mapInPandas(_by_language(held, failure_chunk, frame), COUNTS)
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def _bits(counts: DataFrame, power: int) -> np.ndarray:
    return bitmaps.gather(counts, ["mark"], lambda m: m.to_numpy().view(np.uint64), power)


def propose(sample: DataFrame, least: int, longest: int, power: int = bitmaps.POWER) -> np.ndarray:
    """Filter of the phrases that the sample holds ``least`` times, mined level by level.

    Phrases of full length need no place in it, for nothing extends them.
    """
    before, now = None, bitmaps.empty(power)
    for k in range(1, longest):
        found = border_pass(sample, k, before, now, False).where(F.col("n") >= least)
        before, now = now, now | _bits(found, power)
    return now


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, share: int = SHARE, sample_least: int = SAMPLE_LEAST, power: int = bitmaps.POWER) -> DataFrame:
    """(lang, k, phrase, n): exact counts of all phrases of one to ``longest`` words with ``n >= least``.

    k = 0: the number of words of the language.
    """
    python_tasks(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("lang", F.lit(UND)).alias("lang"), "text").where("text is not null")
    picked = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(share)) == 0
    proposed = propose(materialise(texts.where(picked), "sample"), sample_least, longest, power)
    often = border_pass(texts, longest, None, proposed, True)
    often = materialise(often.where((F.col("n") >= least) | (F.col("phrase") == "")), "border")
    k = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    told = often.where("phrase is not null").select("lang", k.alias("k"), "phrase", "n")
    known = _bits(often.where("phrase is null or phrase <> ''"), power)
    if not (known & ~proposed).any():
        return told  # no border failures
    more = failure_pass(texts, longest, proposed, known)
    return told.unionByName(materialise(more.where(F.col("n") >= least), "counts"))


def _looked_up(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase ``part`` as ``name``; a part that very many phrases share is salted."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    many = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    on = (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part")) & (salt == F.col("_salt"))
    return rows.join(many, on).drop("_lang", "_part", "_salt")


def _words(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, covered: int = 80, **mining) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): candidates that no longer one covers, scored by their weakest cut.

    Cutting after the first k words gives l and r, the counts of both parts, and floor(2000000 * a / (l + r)); the lowest score
    counts, ties to the smallest k.  A candidate goes if a longer candidate holds it and has ``covered`` percent of its count.
    """
    found = frequent_phrases(docs, least, longest, **mining)
    words = found.where("k >= 2").withColumn("words", F.split("phrase", " "))
    parts = found.where(F.col("k").between(1, longest - 1)).select("lang", "phrase", "n")
    totals = found.where("k = 0").groupBy("lang").agg(F.sum("n").alias("total"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _words(i, m))))
    inside = words.where("k > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("n").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    open_ = words.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("longer") < F.lit(covered).cast("decimal(3,0)") * wide("n")))

    cuts = open_.select("lang", "phrase", "words", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _words(F.lit(1), F.col("cut")).alias("_left"), _words(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_right"))
    cuts = _looked_up(_looked_up(cuts, parts, "_left", "l"), parts, "_right", "r")
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.join(F.broadcast(totals) if _few(totals) else totals, "lang").select(
        "lang", "phrase", "a", "best.l", "best.r", F.col("total").alias("n"), "best.score")


def _few(totals: DataFrame, most: int = 10_000) -> bool:
    return totals.limit(most + 1).count() <= most


def ranked(rows: DataFrame, top: int = 2000) -> DataFrame:
    """The first ``top`` of each language, by score and count descending, then by phrase in byte order."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
