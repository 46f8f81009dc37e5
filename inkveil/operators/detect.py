"""Detection: one scan over the texts, every pattern of a profile.

``findings(doc_id, page, category, cat_no, ordinal, match_no, value[, start, end])``
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.headings import is_heading
from inkveil.functions.matching import is_plain, matches, rlike
from inkveil.functions.patterns import Pattern, category_patterns, profile_patterns
from inkveil.functions.pyregex import FOLDS, literal_tree, needed_literals, to_java
from inkveil.functions.spans import context_window, match_spans
from inkveil.functions.validators import VALIDATORS

KEYS = ["doc_id", "page"]
#: Stands for the end of a page where all pages of a document are searched at once: no pattern of a profile matches it, and
#: it is neither a word character nor a blank, so a match beside it is one beside the end of a text.
PAGE_END = "\x01"

# Necessary conditions of pattern families.  Each is far cheaper than the
# patterns it guards and evaluated once per text.
GUARDS = {
    "plus": lambda t, plain: t.contains("+"),
    "digit": lambda t, plain: rlike(t, r"\d", 0, plain),
    "digits2": lambda t, plain: rlike(t, r"\d\d", 0, plain),
    "slash": lambda t, plain: t.contains("/"),
    "slash_dash": lambda t, plain: t.contains("/") | t.contains("-"),
    "card_label": lambda t, plain: rlike(t, r"c[vsi]|security|card", re.IGNORECASE, plain) & rlike(t, r"\d\d\d", 0, plain),
    "digits3": lambda t, plain: rlike(t, r"\d\d\d", 0, plain),
    # Seven digits with nothing but phone separators between them.
    "digits7": lambda t, plain: rlike(t, r"\d\d\d", 0, plain) & rlike(t, r"(?:\d[-.()\s]*+){7}", 0, plain),
    "digits12": lambda t, plain: rlike(t, r"\d\d\d\d", 0, plain) & rlike(t, r"(?:\d[-\s]?){12}", 0, plain),
    # Runs of digits without anything between them.
    "run6": lambda t, plain: rlike(t, r"\d{6}", 0, plain),
    "run13": lambda t, plain: rlike(t, r"\d{13}", 0, plain),
    "capitals": lambda t, plain: rlike(t, r"[A-Z]{6}", 0, plain),
    # A month's number, a hyphen or slash and a digit; a letter, blanks or commas and four digits.
    "month_number": lambda t, plain: (t.contains("/") | t.contains("-")) & rlike(t, r"[01][0-9][-/][0-9]", 0, plain),
    "month_name": lambda t, plain: rlike(t, r"\d\d\d\d", 0, plain) & rlike(t, r"[a-z][,\s]+\d\d\d\d", re.IGNORECASE, plain),
    "tax_number": lambda t, plain: rlike(t, r"[A-Z]\d{4}[A-Z]", 0, plain),
    "at_sign": lambda t, plain: t.contains("@"),
    "at_any": lambda t, plain: t.contains("@") | t.contains("[at]"),
    "bracket": lambda t, plain: rlike(t, r"\[at\]", re.IGNORECASE, plain),
    "dot_word": lambda t, plain: rlike(t, "dot", re.IGNORECASE, plain),
}

# Conditions that hold wherever another one does: they are asked only there.
_STAGES = {"digits7": (["digits3"], lambda t, plain: rlike(t, r"(?:\d[-.()\s]*+){7}", 0, plain)),
           "digits12": (["digits7", "digits3"], lambda t, plain: rlike(t, r"(?:\d[-\s]?){12}", 0, plain)),
           "run6": (["digits3"], GUARDS["run6"]),
           "run13": (["run6", "digits12", "digits7", "digits3"], GUARDS["run13"]),
           "month_name": (["digits3"], lambda t, plain: rlike(t, r"[a-z][,\s]+\d\d\d\d", re.IGNORECASE, plain)),
           "tax_number": (["digits3"], GUARDS["tax_number"])}
# What is left of a condition for a pattern with a literal of its own, which is looked for without a regex.
_BESIDE_LITERAL = {"digit": None, "digits2": None, "dot_word": None, "bracket": None, "at_sign": None, "plus": None, "card_label": "digits3"}


def all_matches(text: Column, p: Pattern, plain: Column | None = None) -> Column:
    return matches(text, p.regex, p.flags, plain)


def guarded_matches(text: Column, p: Pattern) -> Column:
    """Matches of one pattern, or null when its guard already excludes any."""
    name = p.guard
    found = all_matches(text, p)
    return F.when(GUARDS[name](text, None), found) if name else found


def guarded(texts: DataFrame, patterns: list[Pattern], names: list[str | None] | None = None) -> tuple[DataFrame, list[Column | None]]:
    """``texts`` with ``_plain`` and guard columns, and the guard of each pattern (or ``None``); ``names``: other guards than their own."""
    names = [p.guard for p in patterns] if names is None else names
    used = sorted({n for n in names if n})
    plain = F.coalesce(is_plain(F.col("text")), F.lit(True))
    text, asked = F.col("text"), [n for n in used if n not in _STAGES]
    flagged = texts.select("*", plain.alias("_plain")).select("*", *[GUARDS[n](text, F.col("_plain")).alias(f"_{n}") for n in asked])
    for name, (wider, test) in _STAGES.items():
        if name in used:
            known = next((w for w in wider if w in asked), None)
            now = GUARDS[name](text, F.col("_plain")) if known is None else F.col(f"_{known}") & test(text, F.col("_plain"))
            flagged = flagged.select("*", now.alias(f"_{name}"))
            asked.append(name)
    return flagged, [F.col(f"_{n}") if n else None for n in names]


def _literal(p: Pattern) -> str | None:
    """A literal of every match, in lower case, that few texts hold; ``None`` without one."""
    try:
        found = [x for x in needed_literals(p.regex, p.flags) if len(x) > 1 or not x.isalpha()]
    except (re.error, RecursionError, OverflowError):
        return None
    return max(found, key=len, default=None)


def conditioned(pages: DataFrame, patterns: list[Pattern]) -> tuple[DataFrame, list[Column | None], list[Column | None]]:
    """Pages with guard columns, and for each pattern its guard and the test for its literal (or ``None``)."""
    literals = [_literal(p) for p in patterns]
    names = [p.guard if x is None else _BESIDE_LITERAL.get(p.guard, p.guard) for p, x in zip(patterns, literals)]
    flagged, checks = guarded(pages, patterns, names)
    if not any(literals):
        return flagged, checks, literals
    text = F.col("text")
    small = F.lower(F.when(F.col("_plain"), text).otherwise(F.translate(text, *FOLDS)))
    return flagged.select("*", small.alias("_small")), checks, [None if x is None else F.col("_small").contains(x) for x in literals]


def _guarded(pages: DataFrame, patterns: list[Pattern]) -> tuple[DataFrame, list[Column]]:
    """Pages with guard columns, and the match array of each pattern."""
    flagged, checks, literals = conditioned(pages, patterns)
    arrays = []
    for p, check, literal in zip(patterns, checks, literals):
        found = all_matches(F.col("text"), p, F.col("_plain"))
        found = found if literal is None else F.when(literal, found)
        arrays.append(found if check is None else F.when(check, found))
    return flagged, arrays


def _match_lists(pages: DataFrame, patterns: list[Pattern], conditions: list[Column] | None) -> tuple[DataFrame, Column]:
    """Pages with guard columns, and ``array<struct<pat,ms>>``: the numbers of the patterns that match, and their matches.

    Patterns of one guard stand together, so a page that does not meet it makes nothing for them.
    """
    flagged, checks, literals = conditioned(pages, patterns)
    groups: dict[tuple, list[Column]] = {}
    tests, asked = {}, {}
    for i, (p, check, literal) in enumerate(zip(patterns, checks, literals)):
        key = (str(check), None if conditions is None else id(conditions[i]), literal is None)
        if conditions is not None:
            check = conditions[i] if check is None else conditions[i] & check
        tests[key] = check
        entry = F.struct(F.lit(i).alias("pat"), all_matches(F.col("text"), p, F.col("_plain")).alias("ms"))
        groups.setdefault(key, []).append(entry if literal is None else F.when(literal, entry))
        if literal is not None:
            asked[key] = asked[key] | literal if key in asked else literal
    # Whether a page holds any literal of a group is a column, that is compiled; the lists are not.
    flagged = flagged.select("*", *[some.alias(f"_some_{i}") for i, some in enumerate(asked.values())])
    for i, key in enumerate(asked):
        tests[key] = F.col(f"_some_{i}") if tests[key] is None else tests[key] & F.col(f"_some_{i}")
    matched = lambda s: F.size(s["ms"]) > 0
    lists = [F.array(*g) if tests[k] is None else F.when(tests[k], F.array(*g)) for k, g in groups.items()]
    return flagged, F.filter(F.flatten(F.filter(F.array(*lists), lambda g: g.isNotNull())), matched)


def _lookup(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def find(
    pages: DataFrame,
    patterns: list[Pattern],
    spans: bool = False,
    context: int | None = None,
    keep: tuple = (),
    validate: bool = True,
    conditions: list[Column] | None = None,
    unless: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Findings of ``patterns`` in ``pages(doc_id, page, text)``.

    ``conditions``, one per pattern, say on which pages a pattern applies.

    The match lists of all patterns form one array; lists without a match are
    dropped before the array is expanded, so only real matches become rows and
    the text itself leaves the plan.  (Expanding first makes Spark compile all
    patterns into one method too large for the JIT: three times slower.)
    ``context`` adds the text around each match that passes its check, and ``unless`` drops those whose context it holds for;
    both inside the row, so the context is cut for few and dropped matches never become rows.
    """
    keys = [*KEYS, *keep]
    flagged, lists = _match_lists(pages, patterns, conditions)
    hits = flagged.select(*keys, "text", "_plain", F.inline(lists))
    pat = F.col("pat")
    if spans or context is not None:
        regex = F.when(F.col("_plain"), _lookup([p.plain for p in patterns], pat)).otherwise(_lookup([p.java for p in patterns], pat))
        located = F.transform(match_spans(F.col("text"), regex, F.col("ms")), lambda s, i: F.struct(
            i.alias("match_no"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end")))
        passes = _passes(patterns) if validate else None
        if passes is not None:
            located = F.filter(located, lambda s: passes(s["value"]))
        if context is not None:
            located = F.transform(located, lambda s: s.withField("context", context_window(F.col("text"), s["start"], s["end"], context)))
        if unless is not None:
            located = F.filter(located, lambda s: ~unless(s["context"]))
        rows = hits.select(*keys, "pat", F.inline(located))
    else:
        rows = hits.select(*keys, "pat", F.posexplode("ms").alias("match_no", "value"))
        passes = _passes(patterns) if validate else None
        rows = rows if passes is None else rows.filter(passes(F.col("value")))
    extra = [c for c in ("start", "end", "context") if c in rows.columns]
    return rows.select(
        *keys,
        _lookup([p.category for p in patterns], pat).alias("category"),
        _lookup([p.cat_no for p in patterns], pat).alias("cat_no"),
        _lookup([p.ordinal for p in patterns], pat).alias("ordinal"),
        "match_no",
        "value",
        *extra,
    )


def _passes(patterns: list[Pattern]):
    """The validator of the pattern ``pat`` as a test of a value; ``None`` if no pattern has one."""
    names = sorted({p.validator for p in patterns if p.validator})
    if not names:
        return None

    def test(value: Column) -> Column:
        out = F.when(F.lit(False), F.lit(True))
        for name in names:
            ids = [i for i, p in enumerate(patterns) if p.validator == name]
            out = out.when(F.col("pat").isin(ids), VALIDATORS[name](value))
        return out.otherwise(F.lit(True))

    return test


def findings(
    pages: DataFrame,
    profile: str = "redact",
    categories=None,
    mask: str | None = None,
    spans: bool = False,
    preserve_headings: bool = True,
    keep: tuple = (),
) -> DataFrame:
    """All findings of a profile.

    ``strict`` also drops matches whose surroundings (50 characters each side)
    form a heading; ``lang`` picks the pattern set by the ``lang`` column of the
    page.
    """
    if profile == "strict":
        found = find(pages, profile_patterns("strict", categories), spans=True, context=50, keep=keep,
                     unless=lambda context: is_heading(context, "en", preserve_headings)).drop("context")
        return found if spans else found.drop("start", "end")
    if profile == "lang":
        return _lang_findings(pages, categories, spans, keep)
    return find(pages, profile_patterns(profile, categories, mask), spans=spans, keep=keep)


def _lang_findings(pages: DataFrame, categories, spans: bool, keep: tuple) -> DataFrame:
    """Known language: its own set; unknown language: English.  One scan, each pattern on the pages of its set."""
    hindi = F.coalesce(F.col("lang") == "hi", F.lit(False))
    patterns, conditions = [], []
    for lang, condition in (("hi", hindi), ("en", ~hindi)):
        own = profile_patterns("lang", categories, lang=lang)
        patterns += own
        conditions += [condition] * len(own)
    return find(pages, patterns, spans=spans, keep=keep, conditions=conditions)


def _joined(documents: DataFrame, keep: tuple = ()) -> DataFrame:
    """``(doc_id, text)`` of documents whose pages are lines, to be searched for the patterns of a profile at once.

    The matches are those of the pages, in order; which page one stands on is not known.
    """
    return documents.select("doc_id", *keep, F.replace("text", F.lit("\n"), F.lit(PAGE_END)).alias("text"))


def _any_match(p: Pattern) -> Column:
    """Whether ``text`` holds a match of ``p`` that passes its check."""
    if p.validator:
        return F.exists(all_matches(F.col("text"), p, F.col("_plain")), VALIDATORS[p.validator])
    return rlike(F.col("text"), p.regex, p.flags, F.col("_plain"))


def _first_of(texts: DataFrame, patterns: list[Pattern], name: str) -> DataFrame:
    """``texts`` with the number of the first category, in processing order, that has a match; null without one."""
    flagged, checks, literals = conditioned(texts, patterns)
    tests: dict[int, Column] = {}
    for p, check, literal in zip(patterns, checks, literals):
        test = _any_match(p) if literal is None else literal & _any_match(p)
        test = test if check is None else check & test
        tests[p.cat_no] = tests[p.cat_no] | test if p.cat_no in tests else test
    first = F.coalesce(*[F.when(tests[n], F.lit(n)) for n in sorted(tests)])
    return flagged.select(*texts.columns, first.alias(name))


def first_categories(documents: DataFrame, profile: str = "redact", categories=None) -> DataFrame:
    """``(doc_id, category, cat_no)``: the first category found in each row of ``documents(doc_id, text)``, pages being lines.

    Categories are looked for in processing order, and none behind the first that is found; most conditions are not asked
    either where the first category stands.  Rows without findings have nulls: to filter them here would have the optimizer
    write all patterns out again for each use.
    """
    patterns = profile_patterns(profile, categories)
    lead = min(p.cat_no for p in patterns)
    rows = _first_of(_joined(documents), [p for p in patterns if p.cat_no == lead], "_lead")
    rest = [p for p in patterns if p.cat_no != lead]
    if rest:
        open_text = F.when(F.col("_lead").isNull(), F.col("text"))
        rows = _first_of(rows.select("doc_id", "_lead", open_text.alias("text")), rest, "_next")
    found = rows.select("doc_id", F.coalesce(*[c for c in ("_lead", "_next") if c in rows.columns]).alias("cat_no"))
    names = {p.cat_no: p.category for p in patterns}
    return found.select("doc_id", _lookup([names.get(i) for i in range(max(names) + 1)], F.col("cat_no")).alias("category"), "cat_no")


def page_counts(pages: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """``(doc_id, page, counts)``: matches of each pattern, in order, zeros included; one row per page."""
    flagged, arrays = _guarded(pages, patterns)
    # As in find(), a higher-order function keeps the patterns out of one method too large for the JIT.
    counts = F.transform(F.array(*arrays), lambda found: F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0)))
    return flagged.select(*KEYS, counts.alias("counts"))


def count_per_page(pages: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Matches per page and pattern, pages without a match included."""
    flagged, arrays = _guarded(pages, patterns)
    counts = F.inline(
        F.array(*[
            F.struct(
                F.lit(p.category).alias("category"), F.lit(p.ordinal).alias("ordinal"),
                F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0)).alias("n"),
            )
            for p, a in zip(patterns, arrays)
        ])
    )
    return flagged.select(*KEYS, counts)


def match_pattern(pages: DataFrame, regex: str, ignore_case: bool = True) -> DataFrame:
    """Generic matcher: ``(doc_id, page, n, values)``, zero rows included."""
    values = matches(F.col("text"), regex, re.IGNORECASE if ignore_case else 0)
    return pages.select(*KEYS, values.alias("values")).select(*KEYS, F.size("values").alias("n"), "values")


def match_pattern_table(pages: DataFrame, table: DataFrame, at_once: int = 200) -> DataFrame:
    """Every page against a user's table ``(pattern_id INT, regex STRING, ignore_case BOOLEAN)`` of any length.

    The rows become literals of a scan, ``at_once`` of them in each; the scans of a longer table are united.
    Compared with a join against the table each regex is compiled once per task and no page is repeated per pattern.
    """
    scans, held = [], []

    def scan() -> None:
        scans.append(find(pages, list(held)).select(*KEYS, F.col("ordinal").alias("pattern_id"), "match_no", "value"))
        held.clear()

    for r in table.orderBy("pattern_id").toLocalIterator():
        held.append(Pattern("table", 0, r["pattern_id"], r["regex"], r["ignore_case"]))
        if len(held) == at_once:
            scan()
    if held or not scans:
        scan()
    out = scans[0]
    for part in scans[1:]:
        out = out.unionByName(part)
    return out


def match_large_pattern_table(pages: DataFrame, table: DataFrame, at_once: int = 20_000, salts: int = 16) -> DataFrame:
    """As :func:`match_pattern_table` for tables of thousands of patterns: a page meets only patterns that it can match.

    A pattern is filed under a literal that each of its matches holds, the one that the fewest patterns share; one search finds
    all literals of a page, and an equi join brings the patterns filed under them (salted, as a literal may stand on a third of
    the pages).  Each ``at_once`` patterns read the corpus once.  Patterns without a literal of three characters are scanned
    for as before.
    """
    plain, out, rows = [], [], []

    def flush() -> None:
        if rows:
            out.append(_filed(pages, rows, salts))
            rows.clear()

    for r in table.orderBy("pattern_id").toLocalIterator():
        flags = re.IGNORECASE if r["ignore_case"] else 0
        literals = [x[:24] for x in needed_literals(r["regex"], flags) if len(x) >= 3]
        if literals:
            rows.append((r["pattern_id"], to_java(r["regex"], flags, True), to_java(r["regex"], flags), literals))
        else:
            plain.append((r["pattern_id"], r["regex"], r["ignore_case"]))
        if len(rows) == at_once:
            flush()
    flush()
    if plain or not out:
        out.append(match_pattern_table(pages, pages.sparkSession.createDataFrame(plain, "pattern_id int, regex string, ignore_case boolean")))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def _filed(pages: DataFrame, rows: list[tuple], salts: int) -> DataFrame:
    shared = Counter(x for *_, literals in rows for x in set(literals))
    homes = [min(set(literals), key=lambda x: (shared[x], -len(x), x)) for *_, literals in rows]
    known = set(homes)
    # A search shows the longest literal at a place; those that begin it stand there too.
    begun = {x: [x[:n] for n in range(3, len(x) + 1) if x[:n] in known] for x in known}
    spark = pages.sparkSession
    filed = spark.createDataFrame([(h, i, p, j) for h, (i, p, j, _) in zip(homes, rows)], "home string, pattern_id int, plain string, java string")
    shown = spark.createDataFrame([(x, h) for x, hs in begun.items() for h in hs], "literal string, home string")
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    patterns = shown.join(filed, "home").select("literal", "pattern_id", "plain", "java", salt.alias("salt"))
    text = F.lower(F.translate("text", *FOLDS))
    met = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({literal_tree(known)}))"), F.lit(1)))
    hits = pages.select(*KEYS, F.explode(met).alias("literal"), F.pmod(F.xxhash64(*KEYS), F.lit(salts)).cast("int").alias("salt"))
    lists = hits.join(patterns, ["literal", "salt"]).groupBy(*KEYS).agg(
        F.collect_set(F.struct("pattern_id", "plain", "java")).alias("patterns"))  # at most the patterns of one slice
    pairs = pages.join(lists, KEYS).withColumn("_plain", is_plain(F.col("text"))).select(*KEYS, "text", "_plain", F.explode("patterns").alias("p"))
    regex = F.when(F.col("_plain"), F.col("p.plain")).otherwise(F.col("p.java"))
    return pairs.select(*KEYS, "p.pattern_id", F.posexplode(F.regexp_extract_all("text", regex, F.lit(0))).alias("match_no", "value"))


def regex_mask(
    pages: DataFrame,
    regex: str,
    preserve_headings: bool = True,
    lang: str | None = "en",
    blur: bool = False,
) -> DataFrame:
    """Findings of a user regex, ignoring case: one record per occurrence.

    An invalid regex yields a warning and no findings.  Matches that look like headings are
    dropped while headings are preserved; ``lang=None`` takes the language of
    each page from its ``lang`` column.
    """
    spark = pages.sparkSession
    schema = "doc_id bigint, page int, type string, match string, start int, end int, mask string"
    if not is_valid_regex(regex):
        warnings.warn(f"not a valid regular expression, nothing is searched for it: {regex}", stacklevel=2)
        return spark.createDataFrame([], schema)
    patterns = [Pattern("custom", 0, 1, regex, True)]
    keep = () if lang else ("lang",)
    found = find(pages, patterns, spans=True, keep=keep).filter(F.length("value") > 0)
    char = "*" if blur else "█"
    return found.filter(~is_heading(F.col("value"), lang or F.col("lang"), preserve_headings)).select(
        *KEYS,
        F.lit("Custom Pattern").alias("type"),
        F.col("value").alias("match"),
        "start",
        "end",
        F.repeat(F.lit(char), F.length("value")).alias("mask"),
    )


def is_valid_regex(regex: str) -> bool:
    """Whether Python takes ``regex`` and Java has all that it uses."""
    try:
        to_java(regex, re.IGNORECASE)
        return True
    except (re.error, ValueError, RecursionError, OverflowError):
        return False


def scan_secondary(pages: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Distinct values per group in secondary text; only rows with something found."""
    entries = []
    for name, regexes in groups.items():
        found = F.concat(*[matches(F.col("text"), r, re.IGNORECASE) for r in regexes])
        entries.append(F.struct(F.lit(name).alias("group"), F.array_distinct(found).alias("values")))
    return (
        pages.select(*KEYS, F.inline(F.array(*entries)))
        .filter(F.size("values") > 0)
        .select(*KEYS, "group", F.explode("values").alias("value"))
    )


def first_sensitive(text: Column, patterns: dict[str, str]) -> Column:
    """Name of the first kind found, in the given order; null when none."""
    return F.coalesce(*[F.when(rlike(text, r), F.lit(k)) for k, r in patterns.items()])


def cell(pages: DataFrame, profile: str, category: str, mask: str | None = None, spans: bool = False) -> DataFrame:
    """Findings of one profile x category cell."""
    if profile in ("strict", "lang"):
        return findings(pages, profile, [category], spans=spans)
    return find(pages, category_patterns(profile, category, mask), spans=spans)
