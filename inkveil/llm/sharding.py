"""Sharding by sampled splitters, in DataFrame functions only.

Records are range-partitioned by a key (hash of the text, then doc_id, so that equal texts lie together and a group of
any size can still be cut) with splitters from a size-weighted sample; overfull ranges are subdivided.  Running sums
inside the ranges and the totals of the ranges before give each record its exact place in bytes and rows, and the
shards are cut at equal bytes: law ``bytes``, each shard within one record of the mean.  Only ids, sizes and hashes are
shuffled, never texts.

Nulls and odd input: a null text is empty (size 1, crc 0); null doc_ids come first in a group; repeated rows get a slot
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm import ranges
from inkveil.sources.session import materialise


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, k) of each row; one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.substring(F.sha2(text, 256), 1, 16), ranges.sortable("doc_id")).alias("k"),
    )


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    rows = materialise(records(docs), "records")
    bounds = ranges.splitters(rows.select("k", "size"))
    placed = rows.withColumn("r", ranges.range_of(F.col("k"), bounds)).withColumn("one", F.lit(1).cast("long"))
    placed = ranges.before(placed, {"bytes_before": "size", "rows_before": "one"})
    total = rows.agg(F.sum("size")).first()[0] or 1
    number = F.expr(f"cast(((2 * bytes_before + size) * {shards}) div (2 * {total}) as int)")
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "rows_before", number.alias("shard")), "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rows_before").alias("first")))  # a row a shard
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the rows of ``docs`` to ``path/shard=N``, ordered by slot."""
    placed = shard(docs, shards).select(F.col("doc_id").alias("_doc_id"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    placed = placed.withColumn("_copy", F.row_number().over(Window.partitionBy("_doc_id", "_crc").orderBy("slot")))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.drop("shard", "slot", "_crc", "_copy").withColumn("_crc", crc)
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_crc").orderBy(F.lit(0))))
    same = rows["doc_id"].eqNullSafe(placed["_doc_id"]) & (rows["_crc"] == placed["_crc"]) & (rows["_copy"] == placed["_copy"])
    out = rows.join(placed, same).select(*[rows[c] for c in rows.columns if c not in ("_crc", "_copy")], "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
