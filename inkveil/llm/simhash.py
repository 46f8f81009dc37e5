"""SimHash near-duplicates found with a Gray-order hierarchical index.

A fingerprint has a bit where more than half of the shingle hashes have it.  Equal fingerprints are one node.  Two
fingerprints within ``radius`` bits agree on one of ``radius + 1`` parts of their bits, so each is filed under each
part; a file that grows beyond ``LIMIT`` is filed again under parts of the bits not yet fixed, as often as needed, so no
file is cut.  In a file the fingerprints are sorted by Gray rank, runs of neighbours become nodes that hold the bits
they share, shared bits move to upper nodes, and a search adds up differences from the top and drops whole nodes once
they exceed the radius.  A file gives a spanning forest of its links (not all pairs); components join the forests.

Nulls and odd input: a null or empty text has fingerprint 0, linked like any other.  A null doc_id gets a fingerprint,
a null component and no links.  Repeated rows are equal texts.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import LOWER, UPPER, python_tasks, salted_left_join, wrapped
from inkveil.llm.components import components
from inkveil.llm.secrets import blob_of
from inkveil.sources.session import materialise

LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
ALL = (1 << 64) - 1
FANOUT = 16
#: Fingerprints that one file of the index holds at most, unless all their bits are fixed.
LIMIT = 8192
MORE_PRINTS = ("fp2", "fp3", "fp4")


def shingles(text: str | None, size: int) -> list[bytes]:
    """Words between spaces and 09-0D, A-Z lower-cased, in runs of ``size`` (or all of fewer words), in UTF-8."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    return fingerprint_of(shingles(text, size), seed)


def fingerprint_of(parts: list[bytes], seed: int) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(parts), 4096):
        some = parts[at : at + 4096]
        h = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(seed)), np.uint64, len(some))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(parts), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` with ``_fp``, the fingerprint as a signed long."""
    python_tasks(docs.sparkSession)

    @F.pandas_udf("long")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return docs.drop("_fp").withColumn("_fp", udf("text"))


def hex16(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- the index of one file, in numpy ---


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; level 0 are the fingerprints themselves."""

    def __init__(self, fps: np.ndarray):
        self.pattern, self.mask = [fps], [np.full(len(fps), ALL, np.uint64)]
        while len(self.pattern[-1]) > FANOUT:
            low, mask = self.pattern[-1], self.mask[-1]
            starts = np.arange(0, len(low), FANOUT)
            first = np.repeat(low[starts], np.diff(np.append(starts, len(low))))
            shared = np.bitwise_and.reduceat(mask & ~(low ^ first), starts)
            self.pattern.append(low[starts] & shared)
            self.mask.append(shared)
        # What a node holds beyond the node above it.
        self.own = [m & ~np.repeat(up, FANOUT)[: len(m)] for m, up in zip(self.mask, self.mask[1:])] + [self.mask[-1]]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, fingerprint number) that differ in at most ``radius`` bits."""
        top = len(self.pattern) - 1
        q = np.repeat(np.arange(len(queries)), len(self.pattern[top]))
        node = np.tile(np.arange(len(self.pattern[top])), len(queries))
        so_far = np.zeros(len(q), np.int64)
        for level in range(top, -1, -1):
            so_far = so_far + np.bitwise_count((queries[q] ^ self.pattern[level][node]) & self.own[level][node])
            alive = so_far <= radius
            q, node, so_far = q[alive], node[alive], so_far[alive]
            if level:
                below = len(self.pattern[level - 1])
                q, so_far = np.repeat(q, FANOUT), np.repeat(so_far, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = node < below
                q, node, so_far = q[real], node[real], so_far[real]
        return q, node


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each a and b, the smaller root on top."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root[:] = up


def within(differ: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, others: list[np.ndarray], total: int | None) -> np.ndarray:
    """Which pairs (a, b), that differ in ``differ`` bits of the first fingerprint, are links."""
    near = differ <= radius
    if others:
        near &= differ + sum(np.bitwise_count(o[a] ^ o[b]).astype(np.int64) for o in others) <= total
    return near


def forest(fps: np.ndarray, radius: int, others: list[np.ndarray] | tuple = (), total: int | None = None) -> np.ndarray:
    """Root number of each fingerprint of a file under links within ``radius`` (and ``total`` with the others)."""
    order = np.argsort(gray_rank(fps), kind="stable")
    index, root = GrayIndex(fps[order]), np.arange(len(fps))
    for at in range(0, len(fps), 128):
        q, hit = index.near(fps[order][at : at + 128], radius)
        if others:
            a, b = order[q + at], order[hit]
            near = within(np.bitwise_count(fps[a] ^ fps[b]), a, b, radius, others, total)
            q, hit = q[near], hit[near]
        unite(root, q + at, hit)
    out = np.empty(len(fps), np.int64)
    out[order] = order[root]
    return out


# --- distribution ---


def parts_of(mask: int, radius: int) -> list[int]:
    """The bits outside ``mask`` in ``radius + 1`` parts, each with ``mask``."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(len(free) * k / (radius + 1)) for k in range(radius + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def files(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` with mask and key: each fingerprint under parts of its bits, no file larger than ``LIMIT``."""

    masks = parts_of(0, radius)
    rows, done = filed_under(nodes, masks), None
    while True:
        large = materialise(rows.groupBy("mask", "key").count().where(F.col("count") > LIMIT), "large-files")
        finer = {m: parts_of(m, radius) for m in masks}
        if large.isEmpty() or all(m == ALL for m in masks):
            return rows if done is None else done.unionByName(rows)
        fits = rows.join(large, ["mask", "key"], "left_anti")
        done = fits if done is None else done.unionByName(fits)
        deeper = F.create_map(*[x for m, sub in finer.items() for x in (F.lit(signed(m)).cast("long"), longs(sub or [m]))])
        rows = rows.join(large, ["mask", "key"], "left_semi").withColumn("mask", F.explode(deeper[F.col("mask")]))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).select(*done.columns)
        masks = sorted({s for sub in finer.values() for s in sub})


def longs(masks: list[int]) -> Column:
    return F.array(*[F.lit(signed(m)).cast("long") for m in masks])


def filed_under(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """``nodes`` once under each mask, the key being the fingerprint's masked bits."""
    rows = nodes.withColumn("mask", F.explode(longs(masks)))
    return rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def links(filed: DataFrame, radius: int, total: int | None = None) -> DataFrame:
    """``filed(mask, key, fp, id)`` -> edges (u, v) of ids that span all links within ``radius`` bits in each file.

    With more fingerprint columns ``fp2``, ``fp3``, ..., all together may differ in ``total`` bits.
    """

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            held = part if held is None else pd.concat((held, part), ignore_index=True)
            same = (held["mask"].values == held["mask"].values[-1]) & (held["key"].values == held["key"].values[-1])
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield edges_of(held.iloc[:whole], radius, total)
                held = held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield edges_of(held, radius, total)

    spark = filed.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")  # a few numbers a row
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["mask", "key", "fp", *[c for c in filed.columns if c in MORE_PRINTS], "id"]
    rows = filed.select(columns).repartition(n, "mask", "key").sortWithinPartitions("mask", "key", "fp")
    return rows.mapInPandas(search, "u long, v long")


def edges_of(rows: pd.DataFrame, radius: int, total: int | None = None) -> pd.DataFrame:
    """Edges of whole files, rows sorted by file: at most one a row, to the smallest id that its links reach.

    Files of one leaf are compared directly, larger ones by index.
    """
    mask, key, ids = rows["mask"].values, rows["key"].values, rows["id"].values
    fps = rows["fp"].values.view(np.uint64)
    others = [rows[c].values.view(np.uint64) for c in rows.columns if c in MORE_PRINTS]
    new = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
    size = np.diff(np.append(new, len(rows)))
    root = np.arange(len(rows))
    left = np.repeat(np.where(size <= FANOUT, new + size, 0), size) - root  # rows of the file from here on
    for step in range(1, FANOUT):
        i = np.flatnonzero(left > step)
        if not len(i):
            break
        near = within(np.bitwise_count(fps[i] ^ fps[i + step]), i, i + step, radius, others, total)
        unite(root, i[near], i[near] + step)
    for at, n in zip(new[size > FANOUT].tolist(), size[size > FANOUT].tolist()):
        root[at : at + n] = at + forest(fps[at : at + n], radius, [o[at : at + n] for o in others], total)
    linked = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
    linked = linked[np.lexsort((ids[linked], root[linked]))]
    first = np.concatenate(([True], np.diff(root[linked]) != 0)) if len(linked) else np.empty(0, bool)
    low = ids[linked][np.flatnonzero(first)][np.cumsum(first) - 1] if len(linked) else ids[:0]
    return pd.DataFrame({"u": ids[linked][~first], "v": low[~first]})


def near_groups(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links within ``radius`` bits."""
    prints = materialise(fingerprints(docs.select("doc_id", "text"), size).select("doc_id", F.col("_fp").alias("fp")), "fingerprints")
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    nodes = materialise(nodes, "nodes")
    roots = components(links(files(nodes.select("fp", "id"), radius), radius))
    grouped = (
        nodes.join(roots, nodes["id"] == roots["node"], "left")
        .where("n > 1 or root is not null")
        .select("fp", F.coalesce("root", "id").alias("root"))
    )
    rows = salted_left_join(prints, grouped, "fp", "doc_id")
    return rows.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def drop_near(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each group of fingerprints linked within ``radius`` bits: that of the smallest doc_id.

    A document is a doc_id with a text: rows that repeat both are one, texts under one doc_id are judged apart.  Documents with
    a null doc_id are kept as they are; all columns pass.
    """
    known = fingerprints(docs.where("doc_id is not null").select("doc_id", "text"), size)
    prints = materialise(known.select("doc_id", blob_of("text").alias("blob"), F.col("_fp").alias("fp")), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "blob")).alias("first"))
    # A doc_id may have several texts, so a node is a number of its own; stored, it stays the same.
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    roots = components(links(files(nodes.select("fp", "id"), radius), radius))
    grouped = nodes.join(roots, nodes["id"] == roots["node"], "left").groupBy(F.coalesce("root", "id").alias("group"))
    kept = grouped.agg(F.min("first").alias("k")).select("k.doc_id", "k.blob")
    dropped = prints.select("doc_id", "blob").distinct().join(kept, ["doc_id", "blob"], "left_anti")
    dropped = materialise(dropped.select(F.col("doc_id").alias("_doc_id"), F.col("blob").alias("_blob")), "dropped")
    rows = wrapped(docs, "doc_id", "text")
    out = rows.join(dropped.hint("shuffle_hash"), (rows["doc_id"] == dropped["_doc_id"]) & (blob_of(rows["text"]) == dropped["_blob"]), "left_anti")
    twice = materialise(prints.groupBy("doc_id", "blob").count().where("count > 1").select(F.col("doc_id").alias("_doc_id")).distinct(), "twice")
    if twice.isEmpty():
        return out.select("_row.*")
    same = F.col("doc_id") == F.col("_doc_id")
    once = out.join(twice, same, "left_semi").withColumn("_blob", blob_of("text")).dropDuplicates(["doc_id", "_blob"])
    return out.join(twice, same, "left_anti").select("_row.*").unionByName(once.select("_row.*"))
