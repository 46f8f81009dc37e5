"""Ranges of a sort key of about equal size, from sampled splitters, and prefix sums in key order.

A sample of keys is drawn with chances in proportion to the rows' sizes (by a hash of the key, so that a repeated task
draws the same), its weighted quantiles are the splitters, and ranges that prove overfull are sampled again and
subdivided until none is or a range holds one key only.  All of it is DataFrame functions; the driver holds the
sampled keys of a known number of ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most; beyond that number a range grows with the data and its sort spills.
MAX_RANGES = 65536
OVERSAMPLE = 16
OVERFULL = 2.0


def sortable(number: str | Column) -> Column:
    """A long as 16 hex digits in the order of the numbers; null first, as the empty string."""
    c = F.col(number) if isinstance(number, str) else number
    return F.coalesce(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit(""))


def range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(bounds)), ",")  # folded into one constant
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def step(at, jump):
        to = at + jump
        return F.when((to <= len(bounds)) & (F.try_element_at(held, F.least(to, F.lit(len(bounds)))) <= key), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _sample(rows: DataFrame, step: float) -> list[tuple[str, int]]:
    """(key, weight): a row of size s has weight s / step on average."""
    chance = F.xxhash64("k").bitwiseAND(F.lit(2**52 - 1)).cast("double") / float(2**52)
    weight = F.floor(F.col("size") / F.lit(step) + chance)
    return [(r.k, r.w) for r in rows.select("k", weight.alias("w")).where("w >= 1").collect()]


def _cuts(sample: list[tuple[str, int]], pieces: int) -> list[str]:
    total, at, out = sum(w for _, w in sample), 0, []
    for k, w in sorted(sample):
        at += w
        while len(out) < pieces - 1 and at * pieces >= total * (len(out) + 1):
            out.append(k)
    return out


def splitters(rows: DataFrame, rows_each: int = 1_000_000, size_each: int = 64 << 20, least: int = 64) -> list[str]:
    """Sorted boundaries for ``rows(k string, size long)``: no comma in ``k``, ``size`` above zero.

    As many ranges as give ``rows_each`` rows or ``size_each`` of size at most, between ``least`` and ``MAX_RANGES``.
    """
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    if not total.n:
        return []
    pieces = min(MAX_RANGES, max(least, math.ceil(total.n / rows_each), math.ceil(total.size / size_each)))
    bounds = sorted(set(_cuts(_sample(rows, max(1.0, total.size / (pieces * OVERSAMPLE))), pieces)))
    while True:
        held = rows.withColumn("r", range_of(F.col("k"), bounds)).groupBy("r").agg(
            F.count("*").alias("n"), F.sum("size").alias("size"), (F.min("k") < F.max("k")).alias("divisible")
        )
        full = [x for x in held.collect() if x.divisible and (x.n > OVERFULL * total.n / pieces or x.size > OVERFULL * total.size / pieces) and x.n > 1000]
        if not full or len(bounds) >= 4 * MAX_RANGES:
            return bounds
        more = set(bounds)
        inside = rows.withColumn("r", range_of(F.col("k"), bounds)).where(F.col("r").isin([x.r for x in full]))
        # Rows count as much as sizes here, so that a range of many small rows is cut too.
        even = F.col("size") / F.lit(total.size) + F.lit(1.0 / total.n)
        sample = _sample(inside.select("k", even.alias("size")), 2.0 / (pieces * OVERSAMPLE))
        by_range: dict[int, list] = {}
        for k, w in sample:
            by_range.setdefault(_place(bounds, k), []).append((k, w))
        for got in by_range.values():
            more.update(_cuts(got, max(2, math.ceil(sum(w for _, w in got) / OVERSAMPLE) + 1)))
        more.discard("")
        if len(more) == len(bounds):
            return bounds
        bounds = sorted(more)


def _place(bounds: list[str], k: str) -> int:
    from bisect import bisect_right

    return bisect_right(bounds, k)


def before(rows: DataFrame, sums: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """``rows(r, k, ...)`` with, per entry ``name: column`` of ``sums``, the sum over all rows before, in key order.

    A running sum inside each range, plus the totals of the ranges before: a table with a row a range, broadcast.
    """
    by = order or ["k"]
    running = Window.partitionBy("r").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("r").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("r", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    local = rows.select("*", *[(F.sum(c).over(running) - F.col(c)).alias(n) for n, c in sums.items()])
    joined = local.join(F.broadcast(offsets), "r")
    return joined.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
