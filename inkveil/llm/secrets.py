"""Secret scan over an incremental blob ledger.

Every version of every document is a path to a blob, addressed by the SHA-256 of its text.  The ledger holds, per
scanned blob, each rule with its version and the spans it found.  A run scans only pairs of blob and rule version that
the ledger lacks, each blob once however many paths lead to it, appends the findings in one committed write, and joins
the findings of all blobs back to all paths.

Small columns are grouped first (map-side combined), so a text that a third of the documents share is one row before
anything is shuffled; texts move once, by document, and only those of unseen blobs when these are few enough for
Spark's size-checked broadcast.  Of the ledger a run uses the entries of its own blobs: a filter of fixed size, broadcast,
leaves out all others where they are read, so history is read (addresses, not texts) and never shuffled.  In the join back to
the paths, blobs with very many paths are spread over tasks.

Nulls and odd input: a null text is the empty text; a null or repeated doc_id is a path like any other; an empty table
gives an empty result; other columns are ignored by the scan and kept by :func:`mask_secrets`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import bitmaps
from inkveil.llm.common import python_tasks, spread_left_join, wrapped
from inkveil.sources.session import materialise, shared_dir

FOUND = "array<struct<kind:string,version:int,spans:array<struct<begin:int,end:int>>>>"
LEDGER = f"blob binary, mark long, found {FOUND}"


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern``; one whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1


#: Fixed values of the scan, in the order in which spans at one place are listed.
ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
RULES = (Rule("assign", ASSIGN, 12, 1), Rule("access", r"AKIA[A-Z0-9]+", 18), Rule("hex", r"[0-9a-f]{16,}", 16))
PLACEHOLDER = "[REDACTED]"
#: Bytes of found spans that may be broadcast (a span takes 32 at most); more are joined by a shuffle.
BROADCAST_BYTES = 16_000_000


def blob_of(text: Column | str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def find(text: str, rule: re.Pattern, least: int, group: int) -> list[dict]:
    return [
        {"begin": m.start(), "end": m.end()}
        for m in rule.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]


def _scanner(rules: tuple[Rule, ...]):
    @F.pandas_udf(FOUND)
    def scan(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ready = {r.kind: (r, re.compile(r.pattern)) for r in rules}
        for texts, kinds in parts:
            yield pd.Series([
                [{"kind": k, "version": ready[k][0].version, "spans": find(text or "", ready[k][1], ready[k][0].least, ready[k][0].group)} for k in wanted]
                for text, wanted in zip(texts, kinds)
            ])

    return scan


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def mark_of(blob: Column | str) -> Column:
    """The first 60 bits of a blob's address as a number."""
    return F.conv(F.substring(F.hex(blob), 1, 15), 16, 10).cast("long")


def entries_of(blobs: DataFrame, ledger: str) -> DataFrame | None:
    """The ledger's entries of ``blobs``; all others are left out where they are read, so they cost no shuffle."""
    spark = blobs.sparkSession
    seen = read_ledger(spark, ledger)
    if seen is None:
        return None
    bits = spark.sparkContext.broadcast(bitmaps.gather(blobs, [mark_of("blob")], lambda m: m.to_numpy().view(np.uint64)))

    @F.pandas_udf("boolean")
    def wanted(marks: pd.Series) -> pd.Series:
        return pd.Series(bitmaps.has(bits.value, marks.to_numpy().view(np.uint64)))

    return seen.where(wanted("mark")).join(blobs.select("blob"), "blob", "left_semi").select("blob", "found")


def unseen_pairs(blobs: DataFrame, seen: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Per blob with something left to scan: one of its doc_ids and the kinds to scan."""
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if seen is None:
        return blobs.select("blob", "doc_id", F.array(*[F.lit(r.kind) for r in rules]).alias("kinds"))
    done = (
        seen.select("blob", F.explode("found").alias("f"))
        .groupBy("blob").agg(F.collect_set(F.struct(F.col("f.kind").alias("kind"), F.col("f.version").alias("version"))).alias("done"))
    )  # at most one entry for each rule version there ever was
    left = F.array_except(wanted, F.coalesce("done", F.slice(wanted, 1, 0)))
    return (
        blobs.join(done, "blob", "left").withColumn("left", left)
        .where(F.size("left") > 0)
        .select("blob", "doc_id", F.col("left.kind").alias("kinds"))
    )


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks and append it: all paths (doc_id, blob) of ``docs``, and their blobs."""
    spark = docs.sparkSession
    python_tasks(spark)
    paths = materialise(docs.select("doc_id", blob_of("text").alias("blob")), "paths")
    blobs = materialise(paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "blobs")
    todo = unseen_pairs(blobs, entries_of(blobs, ledger), rules).withColumnRenamed("doc_id", "_doc_id")
    texts = docs.select("doc_id", "text")
    one = texts.join(todo, texts["doc_id"].eqNullSafe(todo["_doc_id"]) & (blob_of(texts["text"]) == todo["blob"]))
    found = one.select("blob", mark_of("blob").alias("mark"), _scanner(rules)("text", "kinds").alias("found"))
    found.write.mode("append").parquet(ledger)
    return paths, blobs


def findings(blobs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob of ``blobs`` with any span: spans(begin, rank, kind, end), ordered, of the given rule versions."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
    place = rank[F.concat_ws(":", F.col("f.kind"), F.col("f.version").cast("string"))]
    rows = entries_of(blobs, ledger).select("blob", F.explode(F.filter("found", lambda f: F.size(f["spans"]) > 0)).alias("f"))
    spans = F.transform("f.spans", lambda s: F.struct(s["begin"].alias("begin"), F.col("rank"), F.col("f.kind").alias("kind"), s["end"].alias("end")))
    rows = (
        rows.withColumn("rank", place).where("rank is not null").select("blob", spans.alias("spans"))
        .groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("all"))
    )  # all spans of one text: bounded by its length
    # A blob that stands in the ledger twice has each span twice; equal ones are neighbours.
    once = F.filter("all", lambda s, i: (i == 0) | (s != F.get("all", i - 1)))
    return rows.select("blob", once.alias("spans"))


def scan_documents(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, blob, spans (null: none).  Without ``ledger`` a fresh one is kept."""
    spark = docs.sparkSession
    ledger = ledger or shared_dir(spark, "ledger")
    paths, blobs = update_ledger(docs, ledger, rules)
    return spread_left_join(paths, findings(blobs, ledger, rules), "blob", "doc_id", blobs.select("blob", "n"))


def listed(spans: Column | str) -> Column:
    """kind:begin:end of the spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))
    return F.coalesce(F.array_join(F.transform(spans, one), ","), F.lit(""))


def _masked(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts with their spans replaced, overlapping ones as one; null where there are none."""
    for texts, all_spans in parts:
        out = []
        for text, spans in zip(texts, all_spans):
            if spans is None:
                out.append(None)
                continue
            pieces, at = [], 0
            for s in spans:
                if s["begin"] >= at:
                    pieces += (text[at : s["begin"]], PLACEHOLDER)
                at = max(at, s["end"])
            out.append("".join(pieces) + text[at:])
        yield pd.Series(out, dtype=object)


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """``docs`` with every span of a secret (overlapping ones as one) replaced in ``text``; n_chars follows the text.

    Masks are applied where the text is: the findings, not the texts, are joined by document.
    """
    found = scan_documents(docs, ledger, rules).where("spans is not null").select("doc_id", F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    found = materialise(found.dropDuplicates(["doc_id", "_blob"]).withColumnRenamed("doc_id", "_doc_id"), "found")
    size = found.agg(F.sum(F.lit(64) + 32 * F.size("_spans"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    rows = wrapped(docs, "doc_id", "text")
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["_doc_id"]) & (blob_of(rows["text"]) == found["_blob"]), "left")
    spans = F.transform("_spans", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))
    out = rows.withColumn("_masked", F.pandas_udf(_masked, "string")(F.when(F.col("_spans").isNotNull(), F.col("text")), spans))
    row = F.col("_row").withField("text", F.col("_masked"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_masked").cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(F.col("_spans").isNull(), F.col("_row")).otherwise(row).alias("_row")).select("_row.*")
