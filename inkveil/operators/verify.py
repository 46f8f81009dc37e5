"""Verification: scan masked text again, stricter than detection.

Patterns run case-sensitively and without validators.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.binding import bind
from inkveil.functions.matching import matches, rlike
from inkveil.functions.patterns import TEXT_ORDER, Pattern, category_patterns
from inkveil.functions.pyregex import looks_no_further
from inkveil.operators.detect import KEYS, conditioned, find, guarded_matches

CONTEXT = 20


def strict_again(patterns: list[Pattern]) -> list[Pattern]:
    """The regexes of a profile as the verifier runs them."""
    return [
        replace(p, ignore_case=False, validator=None) for p in patterns if p.ordinal > 0
    ]


def leftover_matches(pages: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """``unredacted_text`` issues with the surrounding text."""
    found = find(pages, strict_again(patterns), context=CONTEXT)
    return found.select(
        *KEYS, F.lit("unredacted_text").alias("type"), "category", "ordinal", "match_no", "context",
        F.col("value").alias("text"),
    )


def leftover_words(pages: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """``unredacted_word`` issues: blank-separated words that contain a match.

    A word meets no condition that its page fails, so a pattern is looked for in the words of those pages only on which it
    can stand.  Words are compared inside the row; only those with a match become rows.
    """
    checks = strict_again(patterns)
    flagged, conditions, literals = conditioned(pages, checks)
    groups: dict[str, list[int]] = {}
    for i, hold in enumerate(conditions):
        groups.setdefault(str(hold), []).append(i)
    order = [i for some in groups.values() for i in some]

    def on_page(i: int) -> Column:
        p, literal = checks[i], literals[i]
        seen = _seen(F.col("text"), p) if looks_no_further(p.regex, p.flags) else F.lit(True)
        return seen if literal is None else literal & seen

    def tested(some: list[int]) -> Column:
        hold, tests = conditions[some[0]], F.array(*[F.coalesce(on_page(i), F.lit(False)) for i in some])
        return tests if hold is None else F.when(hold, tests).otherwise(F.array(*[F.lit(False)] * len(some)))

    def by_pattern(tests: Column, words: Column) -> Column:
        def hits(p: Pattern) -> Column:
            met = F.filter(words, lambda w: _seen(w["word"], p))
            return F.transform(met, lambda w: F.struct(F.lit(p.category).alias("category"), F.lit(p.ordinal).alias("ordinal"), w["word_no"].alias("word_no"), w["word"].alias("word")))

        lists = [F.when(F.get(tests, F.lit(at)), hits(checks[i])) for at, i in enumerate(order)]
        return F.flatten(F.filter(F.array(*lists), lambda found: found.isNotNull()))

    words = F.transform(matches(F.col("text"), r"\S+", 0, F.col("_plain")), lambda w, i: F.struct(i.alias("word_no"), w.alias("word")))
    found = bind(F.flatten(F.array(*[tested(some) for some in groups.values()])), lambda tests: F.when(
        F.exists(tests, lambda t: t), bind(words, lambda some: by_pattern(tests, some))))
    return flagged.select(*KEYS, F.inline(found)).select(
        *KEYS, F.lit("unredacted_word").alias("type"), "category", "ordinal", "word_no", F.col("word").alias("text")
    )


def _seen(text: Column, p: Pattern) -> Column:
    return rlike(text, p.regex, p.flags, F.col("_plain"))


def leftover_secondary(pages: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """``unredacted_image_text`` issues: one per item and pattern, without context."""
    checks = strict_again(patterns)
    hits = F.array_compact(
        F.array(*[
            F.when(
                rlike(F.col("text"), p.regex, p.flags),
                F.struct(F.lit(p.category).alias("category"), F.lit(p.ordinal).alias("ordinal")),
            )
            for p in checks
        ])
    )
    return pages.select(*KEYS, F.inline(hits)).select(
        *KEYS, F.lit("unredacted_image_text").alias("type"), "category", "ordinal"
    )


def summary(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """``(doc_id, n_issues, success)`` for every document."""
    counts = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_issues"))
    return documents.select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.col("n_issues").isNull().alias("success")
    )


def text_leftovers(masked: DataFrame, categories=None, mask: str | None = None) -> DataFrame:
    """Leftovers of the text job per document and category.

    Only the last pattern with leftovers counts for its category.  It is chosen
    inside the row, so nothing is shuffled.
    """
    wanted = [c for c in TEXT_ORDER if categories is None or c in categories]
    entries = []
    for category in wanted:
        patterns = category_patterns("text", category, mask)
        if not patterns:
            continue
        last_first = []
        for p in reversed(patterns):
            found = guarded_matches(F.col("text"), p)
            last_first.append(F.when(F.size(found) > 0, F.struct(F.lit(p.ordinal).alias("ordinal"), found.alias("values"))))
        entries.append(F.struct(F.lit(category).alias("category"), F.coalesce(*last_first).alias("last")))
    return (
        masked.select("doc_id", F.inline(F.array(*entries)))
        .filter(F.col("last").isNotNull())
        .select("doc_id", "category", "last.ordinal", F.size("last.values").alias("n_left"), F.col("last.values").alias("values"))
    )
