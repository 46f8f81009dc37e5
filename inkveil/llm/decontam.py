"""Benchmark decontamination: a prefix-filtered set join with exact windows.

Words are ASCII-lower-cased runs of letters, digits and non-ASCII characters.  A window is ten consecutive words of a
benchmark item (a shorter item is one window).  A window is a set of three-word shingles, and to contain it whole a
document must contain every one, so the necessary prefix is one shingle: the rarest in the corpus, by counts over all
documents.  Documents meet windows on that shingle only; the window must then fit between the ends of the document
(length and positional bounds), and is compared word by word.  A window that many items share is met and compared once; its
items are listed only for the documents that hold it.

The benchmark is held in blocks of bounded size.  One block is the usual case and costs no shuffle of any text; more
blocks are joined one after another, and the hits of the documents are merged.

Nulls and odd input: a null text has no words; an item without words has no window; an item with a null id is counted
under the id ``null``; repeated documents are judged each; empty tables give empty or all-clean results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import python_tasks, slices, wrapped
from inkveil.sources.session import materialise

#: Bytes of UTF-8: a-z, digits and all of non-ASCII stay, A-Z become a-z, the rest separates words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
WINDOW = 10
SHINGLE = 3
#: Characters of benchmark text in one block.
BLOCK_CHARS = 8_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class Block:
    """Windows of some benchmark items, as word numbers (from 1; 0 is any other word).

    A window that many items share stands once, with the number of the list of its items; equal lists are one.
    """

    vocabulary: dict[bytes, int]
    windows: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> (windows x length, list numbers)
    lists: list[np.ndarray]  # item numbers
    items: list[str]

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 1


def build_block(items: list[tuple], window: int = WINDOW) -> Block:
    names = ["null" if item_id is None else str(item_id) for item_id, _ in items]
    texts = [words_of(text) for _, text in items]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts for w in words), 1)}
    if (len(vocabulary) + 1) ** SHINGLE >= 2**63:
        raise ValueError("a block holds too many words; lower BLOCK_CHARS")
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for number, words in enumerate(texts):
        if words:
            ids = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
            by_size.setdefault(min(window, len(words)), []).append((number, ids))
    windows, lists, known = {}, [], {}
    for size, some in sorted(by_size.items()):
        views = [np.lib.stride_tricks.sliding_window_view(ids, size) for _, ids in some]
        owner = np.repeat([number for number, _ in some], [len(v) for v in views])
        rows, place = np.unique(np.concatenate(views), axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack((place.reshape(-1), owner)), axis=0)
        cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
        numbers = []
        for part in np.split(pairs[:, 1], cuts):
            key = part.tobytes()
            if key not in known:
                known[key] = len(lists)
                lists.append(part)
            numbers.append(known[key])
        windows[size] = (rows, np.array(numbers, np.int64))
    return Block(vocabulary, windows, lists, names)


def codes(ids: np.ndarray, base: int, size: int) -> np.ndarray:
    """Number of the shingle that begins at each place; below zero where a word is not the benchmark's."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        code = code * base + part
        known &= part > 0
    return np.where(known, code, -1)


def shingles_of(block: Block) -> dict[int, np.ndarray]:
    """Sorted shingle numbers of all windows, by shingle size (short windows have shorter shingles)."""
    out: dict[int, list] = {}
    for size, (rows, _) in block.windows.items():
        k = min(SHINGLE, size)
        out.setdefault(k, []).append(np.unique(row_codes(rows, block.base, k)))
    return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


def row_codes(rows: np.ndarray, base: int, size: int) -> np.ndarray:
    """Shingle numbers of windows (windows x length), all of whose words are the benchmark's."""
    n = rows.shape[1] - size + 1
    code = np.zeros((len(rows), n), np.int64)
    for k in range(size):
        code = code * base + rows[:, k : k + n]
    return code


def read_batch(texts: pd.Series, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of a batch, a zero after each text, and where each text begins and ends."""
    get, parts, sizes, gap = vocabulary.get, [], [], np.zeros(1, np.int64)
    for text in texts:
        words = words_of(text)
        parts += [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)), gap]
        sizes.append(len(words))
    ends = np.cumsum(np.array(sizes, np.int64) + 1) - 1
    return np.concatenate(parts) if parts else gap, ends - sizes, ends


def corpus_counts(docs: DataFrame, block, listed: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each benchmark shingle (of ``listed``) stands in all documents; one small table per task is summed."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = block.value
        totals = {k: np.zeros(len(v), np.int64) for k, v in listed.items()}
        for part in parts:
            ids, _, _ = read_batch(part["text"], held.vocabulary)
            for k, known in listed.items():
                code = codes(ids, held.base, k)
                code = code[code >= 0]
                at = np.searchsorted(known, code)
                at[at == len(known)] = 0
                totals[k] += np.bincount(at[known[at] == code], minlength=len(known))
        for k, known in listed.items():
            seen = totals[k] > 0
            yield pd.DataFrame({"k": np.int32(k), "code": known[seen], "n": totals[k][seen]})

    rows = docs.select("text").mapInPandas(count, "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n"))
    out = {k: np.zeros(len(v), np.int64) for k, v in listed.items()}
    for r in rows.toLocalIterator():  # as many rows as the block has shingles at most
        out[r.k][np.searchsorted(listed[r.k], r.code)] = r.n
    return out


def prefix_index(block: Block, listed: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> dict[int, tuple]:
    """Per window length: shingle size, sorted prefix shingles, and for each its windows and offsets.

    The prefix of a window is its rarest shingle, of equally rare ones the one of the smallest number.
    """
    index = {}
    for size, (rows, lists) in block.windows.items():
        k = min(SHINGLE, size)
        code = row_codes(rows, block.base, k)
        n = counts[k][np.searchsorted(listed[k], code)]
        offsets = np.where(n == n.min(axis=1, keepdims=True), code, np.iinfo(np.int64).max).argmin(axis=1)
        chosen = code[np.arange(len(code)), offsets]
        order = np.argsort(chosen, kind="stable")
        keys, first, number = np.unique(chosen[order], return_index=True, return_counts=True)
        index[size] = (k, keys, first, number, rows[order], lists[order], offsets[order])
    return index


def find_hits(ids, begins, ends, base, index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and list of items of every window that stands in a text of the batch."""
    found = [(np.empty(0, np.int64),) * 3]
    by_size: dict[int, np.ndarray] = {}
    for size, (k, keys, first, number, rows, lists, offsets) in index.items():
        code = by_size.setdefault(k, codes(ids, base, k)) if k not in by_size else by_size[k]
        where = np.flatnonzero(code >= 0)
        key = np.searchsorted(keys, code[where])
        key[key == len(keys)] = 0
        met = keys[key] == code[where]
        where, key = where[met], key[met]
        if not len(where):
            continue
        times = number[key]
        place = np.repeat(where, times)
        window = np.repeat(first[key], times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
        begin = place - offsets[window]
        doc = np.searchsorted(begins, place, side="right") - 1
        fits = (begin >= begins[doc]) & (begin + size <= ends[doc])  # positional and length bounds
        begin, window = begin[fits], window[fits]
        for j in range(0, len(begin), 100_000):
            b, w = begin[j : j + 100_000], window[j : j + 100_000]
            same = (ids[b[:, None] + np.arange(size)] == rows[w]).all(1)
            found.append((b[same], np.full(int(same.sum()), size), lists[w[same]]))
    return tuple(np.concatenate(x) for x in zip(*found))


SPANS = "n_words long, hits array<struct<begin:long,end:long>>, items array<string>"


def _searcher(block, index):
    """Of each text: words, merged hit spans (in words) and items with windows in it."""

    @F.pandas_udf(SPANS)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, prefixes = block.value, index.value
        for texts in parts:
            ids, begins, ends = read_batch(texts, held.vocabulary)
            begin, size, number = find_hits(ids, begins, ends, held.base, prefixes)
            depth = np.zeros(len(ids) + 1, np.int64)
            np.add.at(depth, begin, 1)
            np.add.at(depth, begin + size, -1)
            hit = (np.cumsum(depth)[:-1] > 0).astype(np.int8)
            edge = np.diff(np.concatenate(([0], hit, [0])))
            runs = np.column_stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
            run_doc = np.searchsorted(begins, runs[:, 0], side="right") - 1
            pairs = np.unique(np.column_stack((np.searchsorted(begins, begin, side="right") - 1, number)), axis=0)
            spans = [[] for _ in begins]
            names = [[] for _ in begins]
            for d, (b, e) in zip(run_doc.tolist(), runs.tolist()):
                spans[d].append({"begin": b - int(begins[d]), "end": e - int(begins[d])})
            for part in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else ():
                lists = [held.lists[n] for n in part[:, 1].tolist()]
                names[int(part[0, 0])] = [held.items[i] for i in np.unique(np.concatenate(lists)).tolist()]
            yield pd.DataFrame({"n_words": ends - begins, "hits": spans, "items": names})

    return search


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``_found``: n_words, hits (word spans, merged) and items (sorted ids as strings).

    ``docs`` needs a text, ``benchmark`` an item_id and a text; other columns of ``docs`` pass.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    listed = ((r.item_id, r.text) for r in benchmark.select("item_id", "text").toLocalIterator())
    base, out = docs.drop("_found"), None
    for items in slices(listed, lambda r: len(r[1] or ""), BLOCK_CHARS):
        block = build_block(items)
        shared = spark.sparkContext.broadcast(block)
        shingles = shingles_of(block)
        index = spark.sparkContext.broadcast(prefix_index(block, shingles, corpus_counts(docs, shared, shingles)))
        found = _searcher(shared, index)("text")
        if out is None:
            out = base.withColumn("_found", found)
        else:
            out = materialise(out, "contamination").withColumn("_more", found).withColumn("_found", _merge("_found", "_more")).drop("_more")
    if out is None:
        block = build_block([])
        out = base.withColumn("_found", _searcher(spark.sparkContext.broadcast(block), spark.sparkContext.broadcast({}))("text"))
    return out.withColumn("_found", F.col("_found").withField("items", F.array_sort(F.array_distinct("_found.items"))))


def _merge(a: str, b: str):
    """Union of the spans and items of two blocks."""
    spans = F.array_sort(F.concat(f"{a}.hits", f"{b}.hits"))
    none = F.array().cast("array<struct<begin:long,end:long>>")

    def step(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        touching = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["begin"])
        return F.when(touching, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.struct(
        F.col(f"{a}.n_words").alias("n_words"), F.aggregate(spans, none, step).alias("hits"),
        F.concat(f"{a}.items", f"{b}.items").alias("items"),
    )


def n_hit(found: str = "_found"):
    return F.aggregate(f"{found}.hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window stands, with their columns."""
    return contamination(wrapped(docs, "text"), benchmark).where(F.size("_found.hits") == 0).select("_row.*")
