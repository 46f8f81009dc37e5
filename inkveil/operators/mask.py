"""Masking of found values.

Two semantics exist and are never mixed.  Page masking hides, on every page of a
document, each value found anywhere in that document.  Text masking consumes the
text pattern by pattern, each pattern seeing what the former ones left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.binding import bind
from inkveil.functions.headings import RULE_LANGUAGES, heading_languages, is_heading, label_content, rule_language
from inkveil.functions.matching import is_plain, rlike
from inkveil.functions.patterns import TEXT_ORDER, TEXT_TOKEN, Pattern, category_patterns, profile_patterns
from inkveil.functions.replacing import cover, folded, one_of_folded, replace_in_order, squeezed
from inkveil.functions.validators import VALIDATORS
from inkveil.operators.collate import ORDER
from inkveil.operators.detect import GUARDS, all_matches
from inkveil.sources.session import materialise

BLOCK_CHAR = "█"
BLUR_CHAR = "*"
# Documents with up to this many targets carry them as one array per document.
LIST_LIMIT = 1000
GRAM = 8
SALTS = 16


def targets(findings: DataFrame, preserve_headings: bool = True) -> DataFrame:
    """Strings to hide per document, in first-seen order of the findings.

    ``(doc_id, cat_no, ordinal, page, match_no, value, hide, kept_in)``: ``hide``
    is the value without its label, ``kept_in`` lists the languages in which the
    value is a heading and stays visible.
    """
    distinct = (
        findings.groupBy("doc_id", "value").agg(F.min(F.struct(*ORDER)).alias("first")).select("doc_id", "value", "first.*")
    )
    if not preserve_headings:
        return distinct.withColumn("hide", F.col("value")).withColumn("kept_in", F.array().cast("array<string>"))
    return distinct.withColumn("hide", label_content(F.col("value"))).withColumn(
        "kept_in", heading_languages(F.col("value"))
    )


def hide_visible(text: Column, hits: Column, lang: Column, char: str) -> Column:
    """Hide, one after the other, the hits that stand on the original ``text``."""
    visible = F.filter(hits, lambda t: ~F.array_contains(t["kept_in"], lang) & text.contains(t["hide"]))
    hides = F.array_distinct(F.transform(visible, lambda t: t["hide"]))
    return bind(hides, lambda values: hide_in_order(text, values, char))


def hide_in_order(text: Column, values: Column, char: str) -> Column:
    """``values`` hidden one after the other, each wherever the former ones left it; the length is kept."""
    odd = F.exists(values, lambda v: v.contains(char) | (v == ""))  # masks may make new occurrences of these
    return replace_in_order(text, values, lambda v: F.repeat(F.lit(char), F.length(v)), odd)


def mask_pages(
    pages: DataFrame,
    wanted: DataFrame,
    blur: bool = False,
    list_limit: int = LIST_LIMIT,
) -> DataFrame:
    """Hide ``targets`` on all pages of their documents; length is preserved.

    Pages need ``lang``; without that column English rules apply.
    """
    out = _with_hits(pages, wanted, list_limit)
    masked = hide_visible(F.col("text"), F.col("hits"), F.col("_rule"), BLUR_CHAR if blur else BLOCK_CHAR)
    return out.select("doc_id", "page", masked.alias("text"), "lang")


def mask_pages_folded(pages: DataFrame, wanted: DataFrame, blur: bool = False, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Hide ``targets`` on all pages of their documents however they are written there.

    An occurrence is found in any case, with any blanks for a blank, and with a line break, blanks around it and a hyphen
    before it between two characters.  The occurrences of all targets together are hidden, also where they overlap; one search
    over a page finds those of any number of targets.  Line ends stay.
    """
    out = _with_hits(pages, wanted, list_limit, squeezed)

    def folds(small: Column) -> Column:
        here = F.filter("hits", lambda t: ~F.array_contains(t["kept_in"], F.col("_rule")) & small.contains(squeezed(t["hide"])))
        return F.filter(F.array_distinct(F.transform(here, lambda t: folded(t["hide"]))), lambda v: v != "")

    char = BLUR_CHAR if blur else BLOCK_CHAR
    hides = F.when(F.size("hits") > 0, bind(squeezed(F.col("text")), folds)).otherwise(_no_values())
    listed = out.withColumn("_hides", hides)
    masked = F.when(F.size("_hides") == 0, F.col("text")).otherwise(bind(one_of_folded(F.col("text"), F.col("_hides")), lambda r: cover(F.col("text"), r, char)))
    return listed.select("doc_id", "page", masked.alias("text"), "lang")


def targets_on_pages(pages: DataFrame, wanted: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``(doc_id, page, hide)``: the targets that occur on each page of their document."""
    here = F.filter(
        "hits", lambda t: ~F.array_contains(t["kept_in"], F.col("_rule")) & F.col("text").contains(t["hide"])
    )
    hides = F.array_distinct(F.transform(here, lambda t: t["hide"]))
    return _with_hits(pages, wanted, list_limit).select("doc_id", "page", F.explode(hides).alias("hide"))


def _with_hits(pages: DataFrame, wanted: DataFrame, list_limit: int, form: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Pages with the targets that may occur on them, in order.

    Documents with few targets take them as one bounded array in an equi join on
    ``doc_id``.  For a document with more, a page only meets the targets that
    share a character gram with it: see :func:`_page_hits`.  Both ways hide the
    targets that stand on the original page, so they mask the same text.  ``form`` is what texts and targets are compared in.
    The targets are stored first: they are read several times, and with the sizes of a stored table Spark can broadcast them
    while they are small.
    """
    if "lang" not in pages.columns:
        pages = pages.withColumn("lang", F.lit("en"))
    # A target that is a heading in every language is never hidden.
    wanted = materialise(wanted.filter(F.size("kept_in") < len(RULE_LANGUAGES)), "targets")
    item = F.struct(*[F.col(c) for c in ORDER], "hide", "kept_in")
    sizes = wanted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_targets"))
    heavy = sizes.filter(F.col("n_targets") > list_limit).select("doc_id")
    any_heavy = not heavy.isEmpty()
    light = wanted.join(heavy, "doc_id", "left_anti") if any_heavy else wanted
    lists = light.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("hits"))
    none = F.array().cast(lists.schema["hits"].dataType)
    if any_heavy:
        heavy_pages = pages.join(heavy, "doc_id", "left_semi")
        heavy_hits = _page_hits(heavy_pages, wanted.join(heavy, "doc_id", "left_semi"), item, form)
        out = (
            pages.join(heavy, "doc_id", "left_anti").join(lists, "doc_id", "left")
            .unionByName(heavy_pages.join(heavy_hits, ["doc_id", "page"], "left"))
        )
    else:
        out = pages.join(lists, "doc_id", "left")
    return out.select(
        "doc_id", "page", "text", "lang", F.coalesce("hits", none).alias("hits"), rule_language(F.col("lang")).alias("_rule")
    )


def _page_hits(pages: DataFrame, wanted: DataFrame, item: Column, form: Callable[[Column], Column]) -> DataFrame:
    """Targets that can occur on each page, ``(doc_id, page, hits)``.

    Each target is filed under that one of its ``GRAM``-character substrings that
    the fewest targets of the document contain (a shorter target is its own
    gram).  A page holding the target holds this gram, so an equi join on the
    grams of the page misses nothing; pages and targets are expanded by their own
    length only, never by one another.
    """
    length = F.least(F.length(form(F.col("hide"))), F.lit(GRAM))
    grams = wanted.select("doc_id", "hide", length.alias("k"), F.explode(_grams(form(F.col("hide")), length)).alias("gram"))
    grams = grams.distinct()
    shared = grams.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = (
        grams.join(shared, ["doc_id", "gram"])
        .groupBy("doc_id", "hide", "k")
        .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    )
    lengths = anchors.groupBy("doc_id").agg(F.collect_set("k").alias("ks"))
    # Targets are few beside pages: they are repeated per salt, so a gram that is
    # on every page of a large document is spread over SALTS tasks.
    salted = (
        anchors.select("doc_id", "hide", "gram")
        .join(wanted, ["doc_id", "hide"])
        .select("doc_id", "gram", item.alias("hit"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    page_grams = (
        pages.join(lengths, "doc_id")
        .select("doc_id", "page", "text", F.explode("ks").alias("k"))
        .select("doc_id", "page", F.explode(F.array_distinct(_grams(form(F.col("text")), F.col("k")))).alias("gram"))
        .withColumn("salt", F.pmod(F.hash("page"), F.lit(SALTS)))
    )
    return (
        page_grams.join(salted, ["doc_id", "gram", "salt"])
        .groupBy("doc_id", "page")
        .agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    )


def _grams(text: Column, k: Column) -> Column:
    """All substrings of ``k`` characters."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), k.cast("string"), F.lit("}))")), F.lit(1))


# ------------------------------------------------- documents in one row ----

def mask_documents(
    documents: DataFrame,
    categories=None,
    mask: str | None = None,
    preserve_headings: bool = True,
    blur: bool = False,
    separator: str = "\n",
) -> DataFrame:
    """The page job on ``documents(doc_id, text[, lang])``, without any shuffle.

    All pages of a document lie in its row, so its targets are gathered and
    hidden inside the row.  Patterns run on the pages that meet their guards; no value holds a ``separator`` (plain text),
    so values are hidden in the whole text at once.  Only values with the mask character in them are hidden page by page:
    as in the page job, a page hides the targets that stand on it before anything is hidden.
    """
    patterns = profile_patterns("redact", categories, mask)
    text = F.col("text")
    lang = rule_language(F.col("lang")) if "lang" in documents.columns else F.lit("en")
    plain = F.col("_plain")
    pages = F.split(text, "\\Q" + separator + "\\E", -1)
    guards = sorted({p.guard for p in patterns if p.guard})

    def matches(some_pages: Column, p: Pattern) -> Column:
        found = F.flatten(F.transform(some_pages, lambda page: all_matches(page, p, plain)))
        return F.filter(found, VALIDATORS[p.validator]) if p.validator else found

    def values(all_pages: Column) -> Column:
        """Strings to hide, in the order in which they were found."""
        def by_guard(kept: Column) -> Column:
            found = F.array_distinct(F.flatten(F.array(*[matches(kept[p.guard or "all"], p) for p in patterns])))
            if preserve_headings:
                found = F.array_distinct(F.transform(F.filter(found, lambda v: ~is_heading(v, lang)), label_content))
            return found

        kept = [F.filter(all_pages, _meets(g, plain)).alias(g) for g in guards]
        return bind(F.struct(all_pages.alias("all"), *kept), by_guard)

    char = BLUR_CHAR if blur else BLOCK_CHAR

    def hide_all(found: Column) -> Column:
        def on_page(page: Column) -> Column:
            here = F.filter(found, lambda h: page.contains(h))
            return F.aggregate(here, page, lambda acc, h: F.replace(acc, h, F.repeat(F.lit(char), F.length(h))))

        odd = F.exists(found, lambda v: v.contains(char) | (v == ""))
        return F.when(odd, F.array_join(F.transform(pages, on_page), separator)).otherwise(
            replace_in_order(text, found, lambda v: F.repeat(F.lit(char), F.length(v))))

    flagged = documents.withColumn("_plain", F.coalesce(is_plain(text), F.lit(True)))
    listed = flagged.select(*documents.columns, bind(pages, values).alias("_hide"))
    masked = F.when(F.size("_hide") == 0, text).otherwise(bind(F.col("_hide"), hide_all))
    return listed.select(*[masked.alias("text") if c == "text" else c for c in documents.columns])


def _meets(guard: str, plain: Column):
    return lambda page: GUARDS[guard](page, plain)


# ------------------------------------------------------------- text job ----

def mask_text(documents: DataFrame, categories=None, mask: str | None = None, items: bool = False) -> DataFrame:
    """Plain-text masking of ``text``: one row-wise expression, no shuffle.

    Categories run in the order card, phone, e-mail, mask; each pattern sees the
    text its predecessors left, and every literal occurrence of each value that it finds becomes the category's token.
    With ``items`` the found values come along as ``items_<category>`` arrays in order.

    The steps are a fold over the patterns, so the plan holds one step however many there are.
    """
    wanted = [c for c in TEXT_ORDER if categories is None or c in categories]
    patterns = [p for c in wanted for p in category_patterns("text", c, mask)]
    others = [c for c in documents.columns if c != "text"]
    text = F.col("text")
    # Tokens are ASCII: a plain text stays plain.
    job = bind(F.coalesce(is_plain(text), F.lit(True)), lambda plain: bind(
        F.array(plain, *[check(text, plain) for check in _TEXT_GUARDS.values()]), lambda tests: _text_job(text, tests, patterns, wanted, mask)))
    out = documents.select(*others, job.alias("_job"))
    lists = [F.col(f"_job.{c}").alias(f"items_{c}") for c in wanted] if items else []
    return out.select(*[F.col("_job.text").alias("text") if c == "text" else c for c in documents.columns], *lists)


# Necessary conditions, checked on the original text: tokens hold no digit, no
# "@" and no "dot", so no later text can meet a condition the original fails.
_TEXT_GUARDS = {
    "digit": lambda t, plain: rlike(t, r"\d", 0, plain),
    "digits3": lambda t, plain: rlike(t, r"\d\d\d", 0, plain),
    "at_sign": lambda t, plain: t.contains("@"),
    "dot_word": lambda t, plain: t.contains("dot"),
    "bracket": lambda t, plain: t.contains("[at]"),
}


def _text_guard(category: str, ordinal: int) -> str | None:
    if category == "email":
        return {1: "at_sign", 2: "dot_word", 3: "bracket"}[ordinal]
    if category == "phone" and ordinal == 1:
        return "digit"
    return "digits3" if category in ("phone", "credit_card") else None


def _text_job(text: Column, tests: Column, patterns: list[Pattern], wanted: list[str], mask: str | None) -> Column:
    """Struct of the masked text and the values of each category; ``tests``: whether the text is plain, and its guards."""
    names = ["plain", *_TEXT_GUARDS]
    none = F.struct(text.alias("text"), *[_no_values().alias(c) for c in wanted])
    if not patterns:
        return none
    rows = F.array(*[
        F.struct(F.lit(p.plain).alias("plain"), F.lit(p.java).alias("java"), F.lit(p.category).alias("category"), F.lit(TEXT_TOKEN[p.category]).alias("token"),
                 F.lit(names.index(_text_guard(p.category, p.ordinal) or "plain")).alias("guard"))
        for p in patterns])

    def step(s: Column, p: Column) -> Column:
        found = F.regexp_extract_all(s["text"], F.when(F.get(tests, F.lit(0)), p["plain"]).otherwise(p["java"]), F.lit(0))

        def taken(m: Column) -> Column:
            done = bind(F.array_distinct(m), lambda values: replace_in_order(s["text"], values, lambda v: p["token"]))
            if mask is not None and mask in TEXT_TOKEN["mask"]:  # a token with the mask in it: each replacement counts
                done = F.when(p["category"] == "mask", F.aggregate(m, s["text"], lambda acc, v: F.replace(acc, v, p["token"]))).otherwise(done)
            kept = [F.when(p["category"] == c, F.concat(s[c], m)).otherwise(s[c]).alias(c) for c in wanted]
            return F.when(F.size(m) > 0, F.struct(done.alias("text"), *kept)).otherwise(s)

        return bind(F.when((p["guard"] == 0) | F.get(tests, p["guard"]), found).otherwise(_no_values()), taken)

    return F.aggregate(rows, none, step)


def _no_values() -> Column:
    return F.array().cast("array<string>")


def drop_sensitive(pages: DataFrame, sensitive: Column) -> DataFrame:
    """Blank the complete secondary text of items that are sensitive."""
    return pages.withColumn(
        "text", F.when(sensitive, F.repeat(F.lit(BLOCK_CHAR), F.length("text"))).otherwise(F.col("text"))
    )
