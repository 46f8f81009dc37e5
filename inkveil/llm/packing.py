"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document takes its words and one end mark.  Longer ones are cut into pieces of a bin each; the rests and all shorter
documents are packed, largest first.  A bin holds at most one document of a source and one of a duplicate cluster.
Bins stand in order of the room left, each source and each cluster has a bitmap of the bins that hold it, and the
search for a bin goes on from the tightest that fits to the next until one is compatible; else a bin is opened.

The table is dealt by a hash over groups of about ``GROUP`` pieces, each packed in one task; a hot source or cluster is
spread over all groups.  Only ids, sizes and hashes move.

Nulls and odd input: a null or empty text has size 1; a null source or cluster conflicts with nothing; null and repeated
doc_ids are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import python_tasks
from inkveil.sources.session import materialise

CAPACITY = 2048
GROUP = 8192
PACKED = "doc_id long, piece int, first_word long, size int, bin string, offset int, bin_used int"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin number of each item, in the given order."""
    levels: dict[int, int] = {}  # room left -> bitmap of bins
    occupied = 0  # bitmap of the rooms that some bin has left
    holds: dict[tuple, int] = {}  # (kind, value) -> bitmap of bins
    out, bins = [], 0
    for size, source, cluster in zip(sizes, sources, clusters):
        if size > capacity:
            raise ValueError("an item is larger than a bin")
        keys = [k for k in (("source", source), ("cluster", cluster)) if k[1] is not None]
        barred = 0
        for k in keys:
            barred |= holds.get(k, 0)
        rooms, found, room = occupied >> size, 0, size
        while rooms:  # successors, tightest first
            skip = (rooms & -rooms).bit_length() - 1
            room += skip
            if found := levels[room] & ~barred:
                break
            rooms >>= skip + 1
            room += 1
        if found:
            mark = found & -found
            levels[room] ^= mark
            if not levels[room]:
                occupied ^= 1 << room
        else:
            mark, room, bins = 1 << bins, capacity, bins + 1
        left = room - size
        levels[left] = levels.get(left, 0) | mark
        occupied |= 1 << left
        for k in keys:
            holds[k] = holds.get(k, 0) | mark
        out.append(mark.bit_length() - 1)
    return out


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cluster_of(text: Column) -> Column:
    """Equal texts, but for A-Z case and white space at the ends, are one cluster."""
    return F.xxhash64(F.lower(F.trim(text)))


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, size (with the end mark), bin, offset in it, bin_used.

    ``docs`` has doc_id, text and source; ``cluster`` is a column of duplicate clusters (default: equal texts).
    """
    python_tasks(docs.sparkSession)
    mark = cluster if cluster is not None else F.when(F.col("text").isNotNull(), cluster_of(F.col("text")))
    rows = docs.select("doc_id", (words(F.col("text")) + 1).alias("size"), F.col("source").cast("string").alias("source"), mark.alias("cluster"))
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    full = F.expr(f"cast((size - 1) div {capacity} as int)")  # pieces that fill a bin, before the last one
    groups = max(1, -(-rows.count() // group))
    last = rows.select(
        "doc_id", full.alias("piece"), (full.cast("long") * capacity).alias("first_word"), (F.col("size") - full.cast("long") * capacity).cast("int").alias("size"),
        "source", "cluster", "uid", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("g"),
    )

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "uid"], ascending=[False, True], kind="stable")
        value = lambda c: [None if pd.isna(x) else x for x in part[c]]
        number = pd.Series(best_fit(part["size"].tolist(), value("source"), value("cluster"), capacity), index=part.index, dtype="int64")
        part = part.assign(n=number)
        return pd.DataFrame({
            "doc_id": part["doc_id"], "piece": part["piece"], "first_word": part["first_word"], "size": part["size"],
            "bin": pd.Series([f"{g}-{n}" for g, n in zip(part["g"], number)], index=part.index, dtype=object),
            "offset": part.groupby("n")["size"].cumsum() - part["size"], "bin_used": part.groupby("n")["size"].transform("sum"),
        })

    packed = last.groupBy("g").applyInPandas(fit, PACKED)
    whole = rows.where(full > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), full - 1)))
    whole = whole.select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_word"), F.lit(capacity).alias("size"),
        F.concat_ws("-", F.lit("full"), F.col("uid"), F.col("piece")).alias("bin"), F.lit(0).alias("offset"), F.lit(capacity).alias("bin_used"),
    )
    return packed.unionByName(whole)
