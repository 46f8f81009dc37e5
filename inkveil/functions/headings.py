"""Heading and label rules: what is kept visible although it matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.binding import bind
from inkveil.functions.matching import extract, rlike
from inkveil.functions.pyregex import to_java

# --------------------------------------------------------------------------
# Label prefixes, heading forms and heading words.
# --------------------------------------------------------------------------
SENSITIVE_PREFIXES = [
    "cvv", "cvc", "cvv2", "cid", "csc", "cvn", "cvd",
    "expiry", "expiration", "exp.", "exp ", "exp:",
    "valid thru", "good thru",
    "iban", "bic", "swift",
    "aadhaar", "pan:", "pan ", "uid",
    "security code", "card code",
]
COMMON_HEADINGS = [
    r"^(?:[A-Z][a-z]*\s*)+:",
    r"^[IVX]{1,5}\.?\s+.*$",
    r"^\d+\.[\d.]*\s+.*$",
    r"^[A-Z\s]{2,}(?::|$)",
    r"^(?:Section|Chapter|Part|Article)\s+\d+",
    r"^[A-Z][a-z]+\s+\d+",
    r"^[-•*]\s+[A-Z]",
    r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s*[:-]",
]
LABEL_HEADINGS = {
    "en": r"^(?:Name|Address|Phone|Email)(?:\s*:|\s*-|\s*–)",
    "de": r"^(?:Name|Adresse|Telefon|E-Mail)(?:\s*:|\s*-|\s*–)",
    "fr": r"^(?:Nom|Adresse|Téléphone|Courriel|Email)(?:\s*:|\s*-|\s*–)",
    "es": r"^(?:Nombre|Dirección|Teléfono|Correo)(?:\s*:|\s*-|\s*–)",
}
HEADING_WORDS = {
    "en": ["summary", "introduction", "conclusion", "overview", "background", "objectives",
           "methodology", "results", "discussion", "recommendations"],
    "hi": ["सारांश", "परिचय", "निष्कर्ष", "पृष्ठभूमि", "उद्देश्य", "कार्यप्रणाली", "परिणाम", "चर्चा", "सिफारिशें"],
    "fr": ["résumé", "introduction", "conclusion", "aperçu", "contexte", "objectifs",
           "méthodologie", "résultats", "discussion", "recommandations"],
    "de": ["zusammenfassung", "einleitung", "schlussfolgerung", "überblick", "hintergrund", "ziele",
           "methodik", "ergebnisse", "diskussion", "empfehlungen"],
    "es": ["resumen", "introducción", "conclusión", "visión general", "antecedentes", "objetivos",
           "metodología", "resultados", "discusión", "recomendaciones"],
}
GENERAL_FORMS = [
    ("roman", r"^[IVX]{1,5}\.?\s+.*$"),
    ("single_word", r"^[A-Z][a-z]*(:|$)"),
    ("all_caps", r"^[A-Z\s]{2,}(:|$)"),
    ("section", r"(Section|Chapter|Title|Part)\s+\d+"),
    ("numbered", r"^\d+\.\s+[A-Z]"),
    ("word_number", r"^[A-Z][a-z]+\s+\d+"),
]
LABEL_VALUE = r"^([A-Z][a-z]+\s*:)\s*(.+)$"
LABEL_SEPARATORS = r"\s:\-–—(\[{<>|/\\+=*&^%$#@!?;,.'\"`~"
# --------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------

# The same two forms with possessive quantifiers: nothing matched is ever given back, so Java needs no stack for it
# and long runs of capitalised words are no danger.  Each repeated part ends where the next begins, so no match is lost.
_STACK_SAFE = {
    COMMON_HEADINGS[0]: r"^(?:[A-Z][a-z]*+\s*+)++:",
    COMMON_HEADINGS[7]: r"^[A-Z][a-z]++(?:\s++[A-Z][a-z]++)*+\s*+[:-]",
}

# Languages with rules of their own; every other language follows English.
RULE_LANGUAGES = ["en", "de", "fr", "es", "hi"]


def strip_text(text: Column) -> Column:
    return F.regexp_replace(text, to_java(r"\A\s+|\s+\Z"), "")


def has_sensitive_prefix(text: Column) -> Column:
    """Trimmed, lower-cased text starts with a label of sensitive data."""
    return _sensitive(strip_text(text))


def _sensitive(stripped: Column) -> Column:
    alternatives = "|".join(r"\Q" + p + r"\E" for p in SENSITIVE_PREFIXES)
    return F.lower(stripped).rlike(f"^(?:{alternatives})")


def _common(stripped: Column) -> Column:
    return rlike(stripped, "|".join(_STACK_SAFE.get(form, form) for form in COMMON_HEADINGS))


def _by_language(stripped: Column, lang: str) -> Column:
    """Label forms and heading words of one rule language."""
    label = LABEL_HEADINGS.get(lang, LABEL_HEADINGS["en"])
    words = HEADING_WORDS.get(lang, HEADING_WORDS["en"])
    first_word = extract(F.lower(stripped), r"^\S+", 0)
    return rlike(stripped, label) | first_word.isin(words)


def is_heading(text: Column, lang: Column | str = "en", preserve: bool = True) -> Column:
    """Heading predicate; ``lang`` is a language code or a column of codes."""
    if not preserve:
        return F.lit(False)

    def decide(stripped: Column) -> Column:
        if isinstance(lang, str):
            by_lang = _by_language(stripped, lang)
        else:
            by_lang = F.when(lang.isNull(), _by_language(stripped, "en"))
            for code in RULE_LANGUAGES[1:]:
                by_lang = by_lang.when(lang == code, _by_language(stripped, code))
            by_lang = by_lang.otherwise(_by_language(stripped, "en"))
        return ~_sensitive(stripped) & (_common(stripped) | by_lang)

    return bind(strip_text(text), decide)


def heading_languages(text: Column) -> Column:
    """Rule languages in which ``text`` is a heading (empty array: in none)."""

    words = sorted({w for some in HEADING_WORDS.values() for w in some})

    def decide(stripped: Column) -> Column:
        # Most values are a heading in no language: one test for all of them goes before those of each.
        some = rlike(stripped, "|".join(LABEL_HEADINGS.values())) | extract(F.lower(stripped), r"^\S+", 0).isin(words)
        each = F.array_compact(F.array(*[F.when(_by_language(stripped, c), F.lit(c)) for c in RULE_LANGUAGES]))
        by_lang = F.when(some, each).otherwise(F.array().cast("array<string>"))
        return (
            F.when(_sensitive(stripped), F.array().cast("array<string>"))
            .when(_common(stripped), F.array(*[F.lit(c) for c in RULE_LANGUAGES]))
            .otherwise(by_lang)
        )

    return bind(strip_text(text), decide)


def rule_language(lang: Column) -> Column:
    return F.when(lang.isin(RULE_LANGUAGES), lang).otherwise("en")


def label_content(value: Column) -> Column:
    """Part of ``Label: content`` behind the label; the whole value without a label."""
    content = extract(value, LABEL_VALUE, 2)
    return F.when(value.contains(":") & (content != ""), content).otherwise(value)


def label_part(value: Column) -> Column:
    return extract(value, LABEL_VALUE, 1)


def heading_form(text: Column, is_label: Column | None = None) -> Column:
    """First general heading form of ``text``; null when there is none.

    ``is_label`` decides the label form; by default a capitalised word that is
    followed by a colon or dash counts as a label.
    """
    if is_label is None:
        is_label = text.rlike(r"^[A-Z][a-z]+\s*[:\-–—]")
    form = F.when(is_label, "label")
    for name, regex in GENERAL_FORMS:
        form = form.when(rlike(text, regex), name)
    return form


def classify_headings(lines: DataFrame, label_words: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Add ``form`` to ``lines``.

    ``label_words(word)`` holds the label vocabulary; lines whose first token is
    in it and is followed by a separator are labels.  Spark broadcasts the table
    only while its size is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    if label_words is None:
        return lines.withColumn("form", heading_form(F.col(text)))
    token = extract(F.col(text), rf"^([^{LABEL_SEPARATORS}]+)[{LABEL_SEPARATORS}]", 1)
    words = label_words.select(F.col("word").alias("_word")).distinct()
    joined = lines.withColumn("_token", token).join(words, F.col("_token") == F.col("_word"), "left")
    form = heading_form(F.col(text), F.col("_word").isNotNull())
    return joined.withColumn("form", form).drop("_token", "_word")
