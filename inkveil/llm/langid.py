"""Language identification with a blended-spectrum n-gram presence kernel.

Texts are lower-cased, characters become symbols of a learned alphabet, and a text is the set of its 1-, 2- and
3-grams.  The kernel of two texts is the number of shared grams over the root of the product of their numbers, counted
over the grams that the landmarks have.  A bounded sample of labelled rows gives Nystrom landmarks and one-versus-rest
kernel ridge regression; whole texts are then scored as batched matrix products (presence x weights, the landmark
kernel folded into the weights), in place, without a shuffle.

Bounds, all parameters of :func:`train`: ``sample`` labelled rows in all, dealt evenly over the languages and chosen by
a hash of doc_id, ``landmarks`` of them, ``alphabet`` symbols.  Only text and lang of the training rows are learned.

The score tells the languages apart, not other texts from them.  For that there is the likeness, the share of the 3-grams
of letters that the landmarks have, with a cut from the likeness of training rows to landmarks that they are not.

Nulls and odd input: a null text, or one without a letter, is ``und`` with score 0; a null lang or doc_id teaches
nothing; without labelled rows every text is ``und``.  Repeated rows are scored alike.  Other columns pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import python_tasks
from inkveil.sources.session import materialise

UND = "und"
BLOCK = 64  # texts in one matrix product
#: Languages whose row counts may be broadcast; more are joined by a shuffle.
LANGUAGES = 10_000


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray  # code point -> symbol, 0 for a character outside the alphabet
    size: int  # symbols with 0
    column: np.ndarray  # gram -> column of the weights, the last one for grams no landmark has
    weights: np.ndarray  # columns x languages
    least: float = 0.0  # likeness that texts of the learned languages reach


#: ``least`` is this share of the first percentile of the training rows' likeness, if there are so many rows.
SHARE, LEAST_ROWS = 0.7, 50
#: 3-grams that say nothing about a language: a name or a token of 12 letters.
FORGIVEN = 10


def symbol_table(characters: list[str]) -> np.ndarray:
    table = np.zeros(0x110000, np.int32)
    table[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
    return table


@lru_cache(1)
def alphabetic() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def three_letters(text: str, symbols: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the 3-grams of a text that are letters only, repeats included: no digits, marks and ends of words."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = alphabetic()[code]
    return grams(text, symbols, size)[2 * len(code) - 1 :][letter[:-2] & letter[1:-1] & letter[2:]] if len(code) > 2 else np.empty(0, np.int32)


def grams(text: str, symbols: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all 1-, 2- and 3-grams of a text, repeats included."""
    s = symbols[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    two = s[:-1] * size + s[1:]
    three = two[:-1] * size + s[2:]
    return np.concatenate((s, two + size, three + (size + size * size)))


def choose(labelled: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows (text, lang, place), evenly over the languages, by a hash of doc_id.

    Of each language a hash share is taken first, some four times the rows wanted, so that ranking them is a small task
    however many rows and tasks there are.
    """
    ids = labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    rows = materialise(ids.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    n = max(1, rows.count())
    each = max(1, sample // n)
    share = F.xxhash64("doc_id").bitwiseAND(F.lit(2**52 - 1)) / float(2**52)
    some = ids.join(F.broadcast(rows) if n <= LANGUAGES else rows, "lang").where(share < F.lit(4.0 * each + 20) / F.col("_n"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = some.drop("_n").withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).limit(sample)
    # A known, small number of ids: their texts are fetched without moving any other.
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])
    return materialise(texts, "language-sample")


def train(labelled: DataFrame, sample: int = 1200, landmarks: int = 240, alphabet: int = 160, ridge: float = 1e-3) -> Model:
    """Fit on ``labelled(doc_id, text, lang)``."""
    python_tasks(labelled.sparkSession)
    rows = choose(labelled, sample)

    def characters(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for part in parts:
            for text in part["text"]:
                total.update((text or "").lower())
        if total:
            yield pd.DataFrame({"c": pd.Series(list(total), dtype=object), "n": list(total.values())})

    counted = rows.select("text").mapInPandas(characters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    letters = [r.c for r in counted.orderBy(F.desc("n"), "c").limit(alphabet).collect()]
    symbols, size = symbol_table(letters), len(letters) + 1

    def presence(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = [np.unique(grams(t or "", symbols, size)).tolist() for t in part["text"]]
            three = [np.unique(three_letters(t or "", symbols, size), return_counts=True) for t in part["text"]]
            made = {"grams": sets, "three": [g.tolist() for g, _ in three], "often": [n.tolist() for _, n in three]}
            yield pd.DataFrame({"doc_id": part["doc_id"], "lang": part["lang"], "place": part["place"], **made})

    found = rows.mapInPandas(presence, "doc_id long, lang string, place int, grams array<int>, three array<int>, often array<int>").collect()
    found = sorted((r for r in found if r.grams), key=lambda r: (r.place, r.lang, r.doc_id))
    languages = sorted({r.lang for r in found})
    column = np.full(size + size**2 + size**3, -1, np.int32)
    if not found:
        return Model([], symbols, size, np.zeros_like(column), np.zeros((1, 0), np.float32))
    known = np.unique(np.concatenate([np.array(r.grams) for r in found[:landmarks]]))
    column[known] = np.arange(len(known))
    column[column < 0] = len(known)
    x = np.zeros((len(found), len(known) + 1), np.float32)
    for i, r in enumerate(found):
        x[i, column[np.array(r.grams)]] = 1
    x = x[:, :-1]
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    marks = x[:landmarks]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])  # K^(-1/2) of the landmarks
    features = (x @ marks.T) @ root
    target = np.array([[r.lang == name for name in languages] for r in found], np.float64)
    share = target.sum(0)
    weight = (target / share).sum(1)[:, None] * len(found) / len(languages)  # each language counts alike
    gram = features.T @ (weight * features) + ridge * len(found) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (weight * target))
    weights = marks.T.astype(np.float64) @ (root @ solved)
    weights = np.vstack((weights, np.zeros((1, len(languages))))).astype(np.float32)
    return Model(languages, symbols, size, column, weights, least_likeness(found, landmarks, column, len(known)))


def least_likeness(found: list, landmarks: int, column: np.ndarray, known: int) -> float:
    """What the training rows say about the likeness of texts in their languages to landmarks that they are not.

    A landmark itself counts only the 3-grams that another one has.
    """
    in_marks = np.bincount(np.concatenate([column[np.array(r.grams)] for r in found[:landmarks]]), minlength=known + 1)
    shares = []
    for i, r in enumerate(found):
        if r.three:
            at, often = column[np.array(r.three)], np.array(r.often)
            there = (at < known) & (in_marks[at] > (1 if i < landmarks else 0))
            shares.append(often[there].sum() / often.sum())
    if len(shares) < LEAST_ROWS:
        return 0.0
    return float(SHARE * np.percentile(shares, 1))


def likeness(text: str, model: Model) -> float:
    """Share of the 3-grams of letters in a text that a landmark has, ``FORGIVEN`` more counted as known."""
    at = model.column[three_letters(text, model.symbols, model.size)]
    return float(((at < model.weights.shape[0] - 1).sum() + FORGIVEN) / (len(at) + FORGIVEN))


def score(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    names, scores = [], []
    width = model.weights.shape[0]
    for at in range(0, len(texts), BLOCK):
        block = texts[at : at + BLOCK]
        there = np.zeros((len(block), width), np.float32)
        lettered = [any(map(str.isalpha, t or "")) for t in block]
        for i, text in enumerate(block):
            if lettered[i] and model.languages:
                there[i, model.column[grams(text, model.symbols, model.size)]] = 1
        there[:, -1] = 0
        out = there @ model.weights / np.sqrt(np.maximum(there.sum(1, keepdims=True), 1))
        for i, row in enumerate(out):
            if lettered[i] and model.languages:
                best = int(row.argmax())
                names.append(model.languages[best])
                scores.append(float(min(1.0, max(0.0, row[best]))))
            else:
                names.append(UND)
                scores.append(0.0)
    return names, scores


def predict(docs: DataFrame, model: Model, judge: bool = False) -> DataFrame:
    """``docs`` with ``_language``: lang_pred and score, from the text alone.

    With ``judge`` also ``like``: whether the text is like any of the languages (see :func:`likeness`).
    """
    spark = docs.sparkSession
    python_tasks(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double" + ", like boolean" * judge)
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for texts in parts:
            names, scores = score(list(texts), held)
            out = pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": scores})
            yield out.assign(like=[likeness(t or "", held) >= held.least for t in texts]) if judge else out

    return docs.drop("_language").withColumn("_language", label("text"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows of ``docs`` that are not held out, and label all."""
    return predict(docs, train(docs.where(~held_out()).select("doc_id", "text", "lang")))
