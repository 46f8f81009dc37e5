"""Small helpers that several corpus operators share."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_LOWER = str.maketrans(UPPER, LOWER)

#: Rows in one Arrow batch of whole texts; the longest texts have some 10^5 characters.
TEXT_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_tasks(spark: SparkSession) -> None:
    """Prepare Python tasks: bound an Arrow batch of texts, and let workers on this machine find the package.

    Executors elsewhere have the package installed or sent with ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def wrapped(docs: DataFrame, *needed: str) -> DataFrame:
    """The whole row as ``_row`` beside the needed columns, so that no other column can clash; ``_row.*`` unwraps."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *[docs[c] for c in needed])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def salted_left_join(rows: DataFrame, lookup: DataFrame, key: str, spread_by: str, salts: int = 32) -> DataFrame:
    """``rows`` left join ``lookup`` (unique ``key``), where one key may hold a third of all rows.

    Rows of a key go to ``salts`` tasks by the hash of ``spread_by``; the lookup row is repeated for each.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    many = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return rows.withColumn("_salt", salt).join(many, [key, "_salt"], "left").drop("_salt")


def spread_left_join(rows: DataFrame, lookup: DataFrame, key: str, spread_by: str, sizes: DataFrame, hot: int = 20_000) -> DataFrame:
    """``rows`` left join ``lookup`` (unique ``key``), given ``sizes(key, n)``, the rows of each key.

    A key with more than one ``hot``-th of all rows is dealt to several tasks, by the hash of ``spread_by``; there are at most
    ``hot`` of these, and they (not their lookup rows) are broadcast.  Nothing is repeated for other keys.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    each = max(1000, total // hot)
    ways = F.broadcast(sizes.where(F.col("n") > each).select(key, F.ceil(F.col("n") / each).cast("int").alias("_ways")))
    ways_of = lambda some: some.join(ways, key, "left").withColumn("_ways", F.coalesce("_ways", F.lit(1)))
    dealt = ways_of(rows).withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.col("_ways")).cast("int")).drop("_ways")
    many = ways_of(lookup).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1))).drop("_ways")
    return dealt.join(many, [key, "_salt"], "left").drop("_salt")


def numbered(stream: list[bytes], mark: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Codes of a batch's words in the order of their first appearance, ``mark`` being 0, and the word of each code."""
    book: dict[bytes, int] = defaultdict()
    book.default_factory = book.__len__
    book[mark]
    codes = np.fromiter(map(book.__getitem__, stream), dtype=np.int64, count=len(stream))
    return codes, list(book)


def slices(rows: Iterable, size, limit: int) -> Iterator[list]:
    """Lists of consecutive rows whose sizes sum to at most ``limit`` (a larger row stands alone)."""
    held, total = [], 0
    for row in rows:
        n = size(row)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held
