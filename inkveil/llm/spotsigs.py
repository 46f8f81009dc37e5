"""SpotSigs document fingerprints, in DataFrame functions only.

Each common word (anchor) of a text starts a chain of the next two content words; the set of chains is the text's
signature set, and its sorted hashes are its fingerprint.  A text without a chain has one signature, of all its words,
so equal texts always have equal fingerprints; a text without words has none.

Sets are compared by Jaccard: lengths that differ too much for the threshold are pruned before any set is read, and
:func:`partners` partitions by set length and joins on the rarest signatures of a set only.

Nulls and odd input: a null text is empty; two empty sets are alike (1.0), an empty and another are not (0.0); null
doc_ids come first in the order of documents; repeated rows are neighbours of each other; a single document is its own
next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm import ranges

#: Fixed anchors: common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "auf das dem den der des die ein eine ist mit nicht sich und von zu "
    "au dans des du elle est et il la le les pour qui sur un une "
    "con de del el en es las los no para por que se su y"
).split()
CHAIN = 2
MARK = "\u0001"


def _words(text: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the sorted distinct signature hashes (array<long>) of a text column.

    Each step is a column of its own, so that none is computed twice.
    """
    anchors = "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))
    marked = F.regexp_replace("_words", f" (?:{anchors})(?= )", f" {MARK}")
    joined = F.regexp_replace(marked, f"{MARK}[{MARK} ]*", MARK)  # the mark sticks to the next content word
    word = f"[^ {MARK}]+"
    chains = F.regexp_extract_all(joined, F.lit(f"{MARK}(?=({word}(?: {MARK}?{word}){{{CHAIN - 1}}}))"), 1)
    found = F.array_distinct(F.transform(chains, lambda c: F.xxhash64(F.translate(c, MARK, ""))))
    whole = F.when(F.length("_words") > 1, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("_words", _words(F.coalesce(text, F.lit("")))).withColumn("_found", found)
    return rows.withColumn(name, F.array_sort(F.when(F.size("_found") > 0, F.col("_found")).otherwise(whole))).drop("_words", "_found")


def printed(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without reading the sets when their lengths rule ``threshold`` out."""
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    jaccard = shared / (n + m - shared)
    pruned = F.least(n, m) < F.greatest(n, m) * threshold
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | pruned, 0.0).otherwise(jaccard)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sig, next_text, next_sig): each document and the next one by doc_id, after the last the first.

    Texts move once, to ranges of doc_id of about equal bytes.  The last row of a range takes the first row of the
    following one from a small table with a row a range.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), ranges.sortable("doc_id").alias("k"))
    bounds = ranges.splitters(rows.select("k", (F.octet_length("text") + 1).cast("long").alias("size")))
    rows = rows.withColumn("r", ranges.range_of(F.col("k"), bounds))
    heads = rows.groupBy("r").agg(F.min("k").alias("k"))  # a row a range
    order = Window.orderBy("r")
    first = F.min(F.struct("r", "k")).over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = heads.select("r", F.coalesce(F.lead(F.struct("r", "k")).over(order), first).alias("n"))
    follow = follow.select("r", F.col("n.k").alias("k"))
    heads_only = rows.select("k", "text").join(F.broadcast(follow.select("k").distinct()), "k")
    head_text = heads_only.groupBy("k").agg(F.min("text").alias("head_text"))
    following = with_signatures(follow.join(head_text, "k").select(F.col("r").alias("_r"), "head_text"), "head_text", "head_sig")
    inside = Window.partitionBy("r").orderBy("k", "text")
    signed = with_signatures(rows, "text", "sig")  # before the shuffle; hashes are a fraction of the text
    led = signed.select("*", F.lead("text").over(inside).alias("next_text"), F.lead("sig").over(inside).alias("next_sig"))
    both = led.join(following, (F.col("r") == F.col("_r")) & F.col("next_text").isNull(), "left")
    return both.select(
        "doc_id", "text", "sig",
        F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_sig", "head_sig").alias("next_sig"),
    )


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by the beginning of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and both likenesses."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = with_signatures(rows, "edited", "edited_sig").select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sig", "next_sig", "edited_sig",
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("sig")).alias("fingerprint"), printed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def partners(queries: DataFrame, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, partner_id, likeness): for each query all documents whose signature sets are alike enough.

    Two alike sets share one of their ``n - ceil(threshold * n) + 1`` rarest signatures (by counts over ``docs``) and
    lie in the same or a neighbouring length partition.  Exact: nothing is capped.  Sets without signatures have no
    partners; equal sets are expanded on the side of the documents only.
    """
    def sets(rows: DataFrame, name: str) -> DataFrame:
        return with_signatures(rows, "text", "sig").select(F.col("doc_id").alias(name), "sig").where(F.size("sig") > 0)

    ours, theirs = sets(queries, "doc_id"), sets(docs, "partner_id")
    held = theirs.groupBy("sig").agg(F.count("*").alias("copies"))
    counts = held.select(F.explode("sig").alias("token"), "copies").groupBy("token").agg(F.sum("copies").alias("df"))
    width = math.log(1 / threshold)

    def prefixes(rows: DataFrame) -> DataFrame:
        tokens = rows.select("sig", F.explode("sig").alias("token")).join(counts, "token", "left")
        ordered = tokens.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("by"))
        n = F.size("sig")
        kept = F.slice("by", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)
        part = F.floor(F.log(n.cast("double")) / width + 1e-9).cast("int")
        return ordered.select("sig", part.alias("part"), F.explode(F.transform(kept, lambda t: t["token"])).alias("token"))

    left = prefixes(ours.select("sig").distinct()).select(F.col("sig").alias("a"), "token", F.explode(F.array(*[F.col("part") + i for i in (-1, 0, 1)])).alias("part"))
    right = prefixes(held.select("sig")).select(F.col("sig").alias("b"), "token", "part")
    pairs = left.join(right, ["token", "part"]).select("a", "b").distinct()
    close = pairs.withColumn("likeness", likeness(F.col("a"), F.col("b"), threshold)).where(F.col("likeness") >= threshold)
    return (
        close.join(ours.withColumnRenamed("sig", "a"), "a").join(theirs.withColumnRenamed("sig", "b"), "b")
        .where("doc_id <> partner_id").select("doc_id", "partner_id", "likeness")
    )
