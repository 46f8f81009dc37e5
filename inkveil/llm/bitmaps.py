"""Set filters of a fixed size: bits of hashes, gathered by Spark and broadcast to Python tasks.

A filter of ``2**power`` bits has that size whatever it holds, so it may be broadcast and may pass through the driver.  It
says "no" for sure and "yes" perhaps; callers count or join exactly what passes, so a filter that fills up costs time and
never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**27 bits are 16 MB; at most 2**30 (128 MB) are accepted.
POWER, MOST_POWER = 27, 30
#: Spark's bitmap functions work on buckets of so many bits.
BUCKET = 32768


def hashes(words: Iterable[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64)


def empty(power: int = POWER) -> np.ndarray:
    if not 15 <= power <= MOST_POWER:
        raise ValueError(f"a filter has 2**15 to 2**{MOST_POWER} bits")
    return np.zeros(2**power // 8, dtype=np.uint8)


def has(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set."""
    at = marks & np.uint64(bits.size * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def gather(rows: DataFrame, columns: list[str | Column], marks: Callable[..., np.ndarray], power: int = POWER) -> np.ndarray:
    """The filter of ``marks(*columns)`` over all ``rows``: tasks set bits, the buckets that hold any come to the driver."""
    mask = np.uint64(2**power - 1)
    n = len(columns)

    def places(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({"at": np.unique(marks(*[part.iloc[:, i] for i in range(n)]) & mask).astype(np.int64) + 1})

    at = rows.select(*columns).mapInPandas(places, "at long")
    buckets = at.groupBy(F.bitmap_bucket_number("at").alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = empty(power)
    for row in buckets.toLocalIterator():
        begin = (row["no"] - 1) * BUCKET // 8
        out[begin : begin + BUCKET // 8] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out
