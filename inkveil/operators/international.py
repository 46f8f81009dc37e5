"""International phone numbers: plus sign, country code, subscriber number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.patterns import CALLING_ONE, CALLING_TWO, CALLING_ZONES, category_patterns
from inkveil.operators.detect import KEYS, find


def calling_codes(spark: SparkSession) -> DataFrame:
    """Country-code dimension ``(code)``; three-digit codes come from their zones."""
    short = spark.createDataFrame([(c,) for c in CALLING_ONE + CALLING_TWO], "code string")
    zones = spark.createDataFrame([(z,) for z in CALLING_ZONES], "zone string")
    long = zones.select("zone", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("d")).select(
        F.concat("zone", F.col("d").cast("string")).alias("code")
    )
    return short.unionByName(long)


def international_phones(pages: DataFrame) -> DataFrame:
    """``(doc_id, page, match_no, value, code)`` of numbers with an assigned country code.

    Country codes are prefix-free, so at most one of the prefixes of one to three
    digits is assigned.  The dimension has fewer than 300 rows.
    """
    candidates = find(pages, category_patterns("redact", "phone")[:1], validate=False)
    digits = F.regexp_replace("value", "[^0-9]", "")
    prefixes = candidates.select(
        *KEYS, "match_no", "value", F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(digits, F.lit(1), n))).alias("code")
    )
    return prefixes.join(F.broadcast(calling_codes(pages.sparkSession)), "code").select(*KEYS, "match_no", "value", "code")
