"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners, by weight: the first owner has the rarest terms, the last the most common ones.  Items (queries)
travel in bundles from owner to owner and carry their accumulators, the scores so far of the documents met.  At each stage
bundles meet the owner's postings (cogroup), whose integer contributions are added; after the last owner the best documents
of each item are selected.

The index is made in one pass without a shuffle: a task reads its documents in blocks and writes, for each term of the
block, the places, counts and lengths of its documents.  A bundle meets the postings of one block at a time, so a group holds
at most some hundred items times a block of documents however common a term is; a term's posting rows are salted.  Only terms
of items are kept: a filter of fixed size (:mod:`.bitmaps`) tests them in the tasks, joins make that exact.

Accumulators that cannot reach an item's result are dropped, exactly: after each stage a histogram of the best partial scores
gives a bound that enough documents have reached; a document whose score and all that its item's later terms can add stay
below it is not among them.  Later terms add at most 1,000,000 times their weight each.

Nulls and odd input: null texts have no term; a null or repeated doc_id is a document of its own (null first among equal
scores); a null or repeated item_id is an item of its own, repeats get the same rows; items without a term that any document
holds, and empty tables, give no rows; a text of any length is one document; all other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm import bitmaps
from inkveil.llm.common import LOWER, UPPER, ascii_lower, numbered, python_tasks
from inkveil.sources.session import materialise

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents in a block, and characters that end a block early.
BLOCK, BLOCK_CHARS = 1024, 16_000_000
#: Items in a bundle, on average.
BUNDLE = 128
#: Owners by least weight; a weight of 6000 is a document frequency of a four-hundredth.
OWNERS = (6000, 4000, 2000, 0)
#: No term adds more than its weight times this.
MOST = 1_000_000
SALTS = 8
#: Steps of the histogram in a doubling of the score.
STEPS = 8

_END = b"\xff"  # stands in no UTF-8 text
_OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_TABLE = bytes.maketrans((UPPER + _OTHER).encode(), (LOWER + " " * len(_OTHER)).encode())
INDEX = "block long, term string, slots binary, tfs binary, ns binary, df long, ids array<long>, n_docs long, n_terms long"
ACCUMULATORS = "bundle long, block long, item long, slots binary, scores binary, steps array<int>, counts array<long>"


def index(docs: DataFrame, vocabulary: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Blocks of ``docs(doc_id, text)``: a row for each term, and one without a term for the block's documents."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def block_rows(number: int, ids: list, texts: list[bytes]) -> pd.DataFrame:
        codes, words = numbered((b" " + _END + b" ").join([b"", *texts]).translate(_TABLE).split(), _END)
        slot = np.cumsum(codes == 0) - 1
        is_term = codes > 0
        lengths = np.bincount(slot[is_term], minlength=len(ids))
        wanted = bitmaps.has(held.value, bitmaps.hashes(words))
        wanted[0] = False
        hit = wanted[codes]
        pair, tf = np.unique(codes[hit] * len(ids) + slot[hit], return_counts=True)
        code, slot = pair // len(ids), pair % len(ids)
        cuts = np.flatnonzero(np.diff(code)) + 1
        rows = [(number, None, None, None, None, None, ids, int((lengths > 0).sum()), int(lengths.sum()))]
        for part in np.split(np.arange(len(code)), cuts) if len(code) else []:
            here = slot[part]
            rows.append((number, words[code[part[0]]].decode(), here.astype("<u4").tobytes(), tf[part].astype("<u4").tobytes(),
                         lengths[here].astype("<u4").tobytes(), len(part), None, None, None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype(
            {"df": "Int64", "n_docs": "Int64", "n_terms": "Int64", "ids": object})

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for part in parts:
            for doc_id, text in zip(part["doc_id"], part["text"]):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append((text or "").encode())
                size += len(text or "")
                if len(ids) >= block or size >= BLOCK_CHARS:
                    yield block_rows(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield block_rows(number, ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(blocks, INDEX)


def _add(n_docs: int, n_terms: int):
    """One stage: the accumulators of a bundle in a block, and the postings of the owner's terms there."""

    def stage(key: tuple, carried: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        bundle, block = key
        scores: dict[int, np.ndarray] = {}
        top = 1 + max((int(np.frombuffer(s, dtype="<u4").max()) for s in [*carried["slots"], *postings["slots"]]), default=0)
        for item, slots, values in zip(carried["item"], carried["slots"], carried["scores"]):
            scores[item] = np.zeros(top, dtype=np.int64)
            scores[item][np.frombuffer(slots, dtype="<u4")] = np.frombuffer(values, dtype="<i8")
        bounds: dict[int, tuple[int, int]] = {}
        for weight, items, slots, tfs, ns in zip(postings["weight"], postings["items"], postings["slots"], postings["tfs"], postings["ns"]):
            at = np.frombuffer(slots, dtype="<u4")
            tf, n = np.frombuffer(tfs, dtype="<u4").astype(np.int64), np.frombuffer(ns, dtype="<u4").astype(np.int64)
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            gain = weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            for entry in items:
                item = entry["item"]
                if item not in scores:
                    scores[item] = np.zeros(top, dtype=np.int64)
                scores[item][at] += gain
                bounds[item] = entry["least"], entry["after"]
        rows = []
        for item, score in scores.items():
            least, after = bounds.get(item, (0, 0))
            kept = np.flatnonzero((score > 0) & (score + after >= least))
            if len(kept):
                best = score[kept]
                if len(best) > 50:
                    best = np.partition(best, len(best) - 50)[-50:]
                steps, counts = np.unique((np.log2(best) * STEPS).astype(np.int64), return_counts=True)
                rows.append((bundle, block, item, kept.astype("<u4").tobytes(), score[kept].astype("<i8").tobytes(), steps.tolist(), counts.tolist()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ACCUMULATORS.split(", ")])

    return stage


def reached(carried: DataFrame, top: int) -> DataFrame:
    """(item, least): a score that at least ``top`` documents of the item have reached already."""
    steps = carried.select("item", F.explode(F.arrays_zip("steps", "counts")).alias("s")).groupBy("item", F.col("s.steps").alias("step"))
    higher = Window.partitionBy("item").orderBy(F.desc("step"))  # some hundred steps an item
    total = steps.agg(F.sum("s.counts").alias("n")).withColumn("so_far", F.sum("n").over(higher))
    edge = F.floor(F.pow(F.lit(2.0), F.max("step") / STEPS) * (1 - 1e-9))
    return total.where(F.col("so_far") >= top).groupBy("item").agg(edge.cast("long").alias("least"))


def search(docs: DataFrame, items: DataFrame, top: int = 50, power: int = bitmaps.POWER, block: int = BLOCK, bundle: int = BUNDLE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` (at most 50) best documents of each row of ``items(item_id, text)``."""
    if not 1 <= top <= 50:
        raise ValueError("top is 1 to 50")
    spark = docs.sparkSession
    python_tasks(spark)
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))
    asked = materialise(items.select("item_id", F.monotonically_increasing_id().alias("item"), terms.alias("terms")), "items")
    bundles = max(1, -(-asked.count() // bundle))
    wanted = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(bundles)).alias("bundle"), F.explode("terms").alias("term"))
    vocabulary = bitmaps.gather(wanted.select("term").distinct(), ["term"], lambda t: bitmaps.hashes(x.encode() for x in t), power)
    rows = materialise(index(docs, vocabulary, block), "index")
    n_docs, n_terms = rows.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        n_docs = n_terms = 1  # nothing will be found

    postings = rows.where("term is not null").select("block", "term", "slots", "tfs", "ns", "df")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    frequency = postings.groupBy("term").agg(F.sum("df").alias("df"))
    owner = F.lit(len(OWNERS))
    for i, least in reversed(list(enumerate(OWNERS))):
        owner = F.when(F.col("weight") >= least, i).otherwise(owner)
    asks = wanted.join(frequency, "term").withColumn("weight", weight).where("weight > 0").withColumn("owner", owner)
    asks = materialise(asks.select("item", "bundle", "term", "weight", "owner"), "asks")

    carried = spark.createDataFrame([], ACCUMULATORS)
    least = spark.createDataFrame([], "item long, least long")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    for stage in range(len(OWNERS)):
        later = asks.groupBy("item").agg(F.sum(F.when(F.col("owner") > stage, F.col("weight") * MOST).otherwise(0)).alias("after"))
        mine = asks.where(F.col("owner") == stage).join(later, "item").join(least, "item", "left")
        entry = F.struct("item", F.coalesce("least", F.lit(0).cast("long")).alias("least"), "after")
        mine = mine.groupBy("bundle", "term", "weight").agg(F.collect_list(entry).alias("items"))  # at most a bundle of items
        mine = mine.withColumn("_salt", salts)
        met = postings.withColumn("_salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(mine, ["term", "_salt"])
        met = met.select("bundle", "block", "weight", "items", "slots", "tfs", "ns")
        step = carried.groupBy("bundle", "block").cogroup(met.groupBy("bundle", "block")).applyInPandas(_add(n_docs, n_terms), ACCUMULATORS)
        carried = materialise(step, "bundles")
        least = materialise(reached(carried, top), "reached")

    return _selected(carried, least, rows, asked, top)


def _selected(carried: DataFrame, least: DataFrame, rows: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [np.zeros((0, 4), dtype=np.int64)]
            for item, block, slots, scores, least in zip(part["item"], part["block"], part["slots"], part["scores"], part["least"]):
                score = np.frombuffer(scores, dtype="<i8")
                kept = np.flatnonzero(score >= least)
                if len(kept):
                    slot = np.frombuffer(slots, dtype="<u4")[kept].astype(np.int64)
                    rows.append(np.column_stack([np.full(len(kept), item), np.full(len(kept), block), slot, score[kept]]))
            yield pd.DataFrame(np.concatenate(rows), columns=["item", "block", "slot", "score"])

    found = carried.join(least, "item", "left").select("item", "block", "slots", "scores", F.coalesce("least", F.lit(0)).alias("least"))
    found = found.mapInPandas(unpack, "item long, block long, slot long, score long")
    blocks = rows.where("ids is not null").select("block", "ids")
    found = found.join(blocks, "block").select("item", "score", "block", "slot", F.get("ids", F.col("slot").cast("int")).alias("doc_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "block", "slot")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return asked.select("item", "item_id").join(best, "item").select("item_id", "rank", "doc_id", "score")
