"""Connected components by alternating small-star and large-star steps, each a map-side combined minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.sources.session import materialise

#: A node with more edges than ``HUB``, or one ``HUBS``-th of all, is a hub; so there are at most ``HUBS`` hubs.
HUB, HUBS = 1000, 20_000


def _with_min(edges: DataFrame, n: int) -> DataFrame:
    """Each of ``n`` edges (u, v) with the smallest of u and its neighbours.

    Hubs have a bounded number and are broadcast, so their edges stay where they are; no other node has many edges.
    """
    lows = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    lows = materialise(lows.select("u", F.least("u", "low").alias("low"), "n"), "lows")
    hub = F.col("n") > max(HUB, n // HUBS)
    hubs, rest = F.broadcast(lows.where(hub).drop("n")), lows.where(~hub).drop("n")
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(rest, "u"))


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` (any direction, repeats and loops allowed) -> (node, root): the smallest node reachable.

    Nodes that are their own root, or stand in no edge to another node, are not listed.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = materialise(now, "edges"), None
    while True:
        # First each node to its smallest smaller neighbour: edges from forests collapse before both directions are needed.
        small = _with_min(now, now.count())
        small = small.select(F.col("v").alias("a"), "low").unionByName(small.select(F.col("u").alias("a"), "low"))
        small = small.where("a <> low").select(F.col("a").alias("u"), F.col("low").alias("v")).distinct()
        small = materialise(small, "edges")
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both, both.count()).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        now = materialise(large, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
