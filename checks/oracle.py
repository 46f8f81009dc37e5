"""DuckDB statement per query; each key has the columns of its Spark query."""

from __future__ import annotations

from checks import sql as S
from inkveil.functions import headings as H
from inkveil.functions.patterns import (
    CALLING_ONE, CALLING_TWO, CALLING_ZONES, LANG, SECONDARY_GROUPS, SECONDARY_MINIMAL, TEXT_ORDER, TEXT_TOKEN, Pattern,
    category_patterns, profile_patterns,
)
from inkveil.operators.verify import strict_again
from inkveil.plans import catalog as C
from inkveil.plans.options import LANGUAGES

q = S.q
REDACT = profile_patterns("redact")
SCAN = profile_patterns("scan")
STRICT = profile_patterns("strict")
ITEM = "doc_id, value, ordinal, page, match_no"
FINDING = "doc_id, page, category, cat_no, ordinal, match_no, value"
LANG_PAGES = f"SELECT doc_id, text, page, CASE WHEN abs(doc_id) % 4 = 0 THEN 'hi' ELSE lang END AS lang FROM ({S.CORPUS})"
FILES = (
    "SELECT doc_id, source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' "
    "ELSE '.PDF' END AS path, n_chars, text FROM documents"
)


def corpus(patterns, pages=S.CORPUS, validate=True):
    return S.with_findings(pages, patterns, validate)


def lang_found(categories=None):
    parts = []
    for lang, where in (("hi", "lang = 'hi'"), ("en", "lang <> 'hi'")):
        patterns = profile_patterns("lang", categories, lang=lang)
        if patterns:
            parts.append(S.hits(patterns, f"(SELECT * FROM src WHERE {where})"))
    return (
        f"WITH src AS MATERIALIZED (SELECT *, {S.NORM} AS norm FROM ({LANG_PAGES})), found AS ({' UNION ALL '.join(parts)})"
    )


def strict_found(categories=None):
    patterns = profile_patterns("strict", categories)
    return S.with_spans(S.CORPUS, patterns) + (
        f", kept AS (SELECT *, {S.context(50)} AS context FROM found)"
    )


STRICT_KEEP = f"NOT {S.heading('context')}"


def text_steps(categories=None, mask=C.MASK):
    steps = []
    for c in TEXT_ORDER:
        if categories is None or c in categories:
            steps += [(p, TEXT_TOKEN[c]) for p in category_patterns("text", c, mask)]
    return steps


def text_job(docs, steps):
    return f"WITH {S.text_steps(docs, steps)}", f"step_{len(steps)}"


def text_items(category):
    """Items of one category of the text job, in order."""
    steps = text_steps()
    head, last = text_job(S.CORPUS_DOCS, steps)
    lists = [f"m_{i}" for i, (p, _) in enumerate(steps, 1) if p.category == category]
    joined = " || ".join(lists)
    return head, last, joined


def leftovers(docs_cte, docs, patterns_by_category):
    """Last pattern with leftovers per document and category."""
    parts = []
    for patterns in patterns_by_category:
        for p in patterns:
            parts.append(
                f"SELECT doc_id, '{p.category}' AS category, CAST({p.ordinal} AS INTEGER) AS ordinal, "
                f"{S.extract(p, norm=S.NORM)} AS ms FROM {docs}"
            )
    return (
        f"{docs_cte} SELECT doc_id, category, ordinal, CAST(len(ms) AS INTEGER) AS n_left, array_to_string(ms, '|') AS items FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY ordinal DESC) AS rn FROM ("
        f"{' UNION ALL '.join(parts)}) WHERE len(ms) > 0) WHERE rn = 1"
    )


def masked(char="█", preserve=True, mask=None):
    patterns = profile_patterns("redact", mask=mask)
    return corpus(patterns) + f", masked AS MATERIALIZED ({S.masked(char, preserve)})"


VERIFY = strict_again(REDACT)
REMASKED = masked() + f", again AS MATERIALIZED (SELECT *, {S.NORM} AS norm FROM masked)"

TRIGRAMS = (
    "unnest(list_transform(range(1, len(text) - 1), lambda i: substr(lower(text), CAST(i AS INT), 3)))"
)


def language(pages, labelled=S.DOCS):
    return (
        f"WITH pg AS ({pages}), grams AS (SELECT lang, {TRIGRAMS} AS gram FROM ({labelled})), "
        "counts AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY lang, gram), "
        "profile AS (SELECT lang, gram, 301 - rank AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank "
        "FROM counts) WHERE rank <= 300), "
        f"pgrams AS (SELECT doc_id, page, {TRIGRAMS} AS gram FROM pg), "
        "scores AS (SELECT doc_id, page, p.lang, sum(weight) AS score FROM pgrams JOIN profile p USING (gram) GROUP BY doc_id, page, p.lang), "
        "best AS (SELECT doc_id, page, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, lang) AS rn FROM scores) WHERE rn = 1), "
        "detected AS (SELECT pg.doc_id, pg.page, coalesce(best.lang, 'en') AS lang FROM pg LEFT JOIN best ON pg.doc_id = best.doc_id AND pg.page = best.page)"
    )


def heading_form(t):
    forms = f"CASE WHEN regexp_matches({t}, {q('^[A-Z][a-z]+' + chr(92) + 's*[:' + chr(92) + '-–—]')}) THEN 'label' "
    forms += " ".join(f"WHEN regexp_matches({t}, {q(r)}) THEN {q(n)}" for n, r in H.GENERAL_FORMS)
    return forms + " END"


def phrase_counts(found):
    return f"{found}, counts AS ({S.COUNTS})"


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    # ---- sources and sinks
    o["page_scan"] = f"SELECT doc_id, page, text FROM ({S.DOC_PAGES})"
    # The same bytes as lists of numbers.  No letter of the texts makes valid UTF-8 by chance: leading bytes are never followed up.
    pairs = "list_transform(range(1, len({0}), 2), lambda i: {1})"
    le, be = "{0}[i] + 256 * {0}[i + 1]", "256 * {0}[i] + {0}[i + 1]"
    unit = lambda form, b: pairs.format(b, form.format(b))
    paired = (
        "len(list_filter(range(1, len({0}) + 1), lambda i: ({0}[i] BETWEEN 55296 AND 56319 AND coalesce({0}[i + 1], 0) NOT BETWEEN 56320 AND 57343) "
        "OR ({0}[i] BETWEEN 56320 AND 57343 AND (i = 1 OR {0}[i - 1] NOT BETWEEN 55296 AND 56319)))) = 0"
    )
    drawn = (
        "array_to_string(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN {0}[i] BETWEEN 55296 AND 56319 "
        "THEN chr((65536 + ({0}[i] - 55296) * 1024 + {0}[i + 1] - 56320)::INT) WHEN {0}[i] BETWEEN 56320 AND 57343 THEN '' ELSE chr({0}[i]::INT) END), '')"
    )
    o["text_decode"] = (
        "WITH f AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '^[\\x{00}-\\x{FF}]*$') THEN doc_id % 8 ELSE 0 END AS form, "
        "list_transform(string_split(text, ''), lambda c: unicode(c)::INT) AS u FROM documents), "
        "b AS (SELECT *, CASE form WHEN 1 THEN [254, 255] || flatten(list_transform(u, lambda x: [0, x])) WHEN 2 THEN flatten(list_transform(u, lambda x: [x, 0])) "
        "WHEN 3 THEN flatten(list_transform(u, lambda x: [0, x])) WHEN 4 THEN u WHEN 6 THEN [255, 254] || flatten(list_transform(u, lambda x: [x, 0])) "
        "WHEN 7 THEN flatten(list_transform(u, lambda x: [x, 0])) || [33] END AS b FROM f), "
        f"w AS (SELECT *, {unit(le, 'b')} AS le, {unit(be, 'b')} AS be, len(b) % 2 = 0 AS even, list_max(b) < 128 AS plain FROM b), "
        "c AS (SELECT *, CASE WHEN form IN (0, 5) OR plain THEN 'utf-8' WHEN form IN (1, 6) THEN 'utf-16' "
        f"WHEN even AND {paired.format('le')} THEN 'utf-16' WHEN even AND {paired.format('be')} THEN 'utf-16be' ELSE 'iso-8859-1' END AS codec FROM w) "
        "SELECT doc_id, codec, regexp_replace(CASE WHEN form IN (0, 1, 5, 6) THEN text WHEN codec IN ('utf-8', 'iso-8859-1') THEN array_to_string(list_transform(b, lambda x: chr(x)), '') "
        f"WHEN codec = 'utf-16' THEN {drawn.format('le')} ELSE {drawn.format('be')} END, '\\r\\n?', chr(10), 'g') AS text FROM c"
    )
    o["route_by_suffix"] = f"SELECT doc_id, path, CASE WHEN lower(path) LIKE '%.txt' THEN 'text' ELSE 'page' END AS route FROM ({FILES})"
    o["admission_filter"] = (
        "SELECT doc_id, name, size, CASE WHEN name IS NULL THEN 'no_file' WHEN name = '' THEN 'empty_name' "
        "WHEN NOT lower(name) LIKE '%.pdf' THEN 'not_pdf' WHEN size > 52428800 THEN 'too_large' END AS reject_reason FROM ("
        "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN '' ELSE path END AS name, n_chars * 10000 AS size "
        f"FROM ({FILES}))"
    )
    head, last = text_job(S.DOCS, text_steps())
    o["redacted_sink"] = (
        f"{head} SELECT f.doc_id, regexp_replace(f.path, '(\\.[^.]+)$', '_redacted\\1') AS out_path, "
        f"'redacted_' || string_split(f.path, '/')[-1] AS upload_name, s.text FROM {last} s JOIN ({FILES}) f ON s.doc_id = f.doc_id"
    )
    out = "regexp_replace(string_split(path, '/')[-1], '(\\.[^.]+)$', '_redacted\\1')"
    o["redacted_files"] = corpus(REDACT, S.DOC_PAGES) + (
        f", masked AS MATERIALIZED ({S.masked('█')}) SELECT {out} AS name, CAST(strlen(t) AS BIGINT) AS length, t AS text FROM ("
        f"SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS t FROM masked GROUP BY doc_id) JOIN (SELECT doc_id, path FROM ({FILES})) USING (doc_id)"
    )
    label = "coalesce(" + ", ".join(f"CASE category WHEN {q(k)} THEN {q(v)} END" for k, v in S.CATEGORY_LABEL.items()) + ")"
    o["report_files"] = corpus(REDACT, S.DOC_PAGES) + (
        f", items AS ({S.ITEMS}), lists AS (SELECT doc_id, category, {label} AS label, string_agg(value, '|' ORDER BY cat_no, ordinal, page, match_no) AS items "
        "FROM items GROUP BY doc_id, category), totals AS (SELECT doc_id, count(*) AS total FROM items GROUP BY doc_id) "
        "SELECT regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') || '_redaction_report.json' AS name, string_split(path, '/')[-1] AS input_file, "
        f"{out} AS output_file, coalesce(total, 0) AS total_items_redacted, label AS category, items "
        f"FROM ({FILES}) f LEFT JOIN lists USING (doc_id) LEFT JOIN totals USING (doc_id)"
    )
    o["output_files_check"] = (
        "SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 'missing' ELSE 'empty' END AS problem FROM documents WHERE doc_id % 10 IN (3, 4)"
    )
    o["redaction_report"] = corpus(REDACT) + (
        f", items AS ({S.ITEMS}), totals AS (SELECT doc_id, count(*) AS total FROM items GROUP BY doc_id) "
        "SELECT i.doc_id, CAST(0 AS INTEGER) AS part, category, count(*) AS n_items, any_value(total) AS total_items_redacted, "
        "string_agg(value, '|' ORDER BY cat_no, ordinal, page, match_no) AS items FROM items i JOIN totals t ON i.doc_id = t.doc_id "
        "GROUP BY i.doc_id, category"
    )
    o["sensitivity_report"] = corpus(SCAN) + (
        ", totals AS (SELECT doc_id, count(*) AS total FROM found GROUP BY doc_id) "
        "SELECT i.doc_id, CAST(0 AS INTEGER) AS part, category, count(*) AS n_findings, any_value(total) AS total_findings, "
        "string_agg(value || '@' || page, '|' ORDER BY cat_no, ordinal, page, match_no) AS items FROM found i JOIN totals t ON i.doc_id = t.doc_id "
        "GROUP BY i.doc_id, category"
    )
    o["output_check"] = (
        "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'missing' ELSE 'empty' END AS problem FROM documents WHERE doc_id % 10 IN (3, 4)"
    )
    # ---- options, projections, filters
    both = profile_patterns("redact", mask=C.MASK)
    o["category_select"] = corpus(both) + (
        " SELECT 'all' AS selection, category, count(*) AS n FROM found WHERE category <> 'mask' GROUP BY category UNION ALL "
        "SELECT 'mail_and_cards', category, count(*) FROM found WHERE category IN ('email', 'credit_card') GROUP BY category UNION ALL "
        "SELECT 'mask_only', category, count(*) FROM found WHERE category = 'mask' GROUP BY category"
    )
    o["language_option"] = (
        f"SELECT doc_id, requested, CASE WHEN requested IN {S.word_list(LANGUAGES)} THEN requested ELSE 'auto' END AS language FROM ("
        "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(lang) WHEN 1 THEN 'xx' ELSE lang END AS requested FROM documents)"
    )
    o["sensitive_prefix_filter"] = f"SELECT doc_id, page, text FROM ({S.CORPUS}) WHERE {S.prefix('text')}"
    o["is_heading"] = f"SELECT doc_id, page, lang, {S.heading('text', 'lang')} AS is_heading FROM ({S.CORPUS})"
    o["heading_taxonomy"] = f"SELECT doc_id, page, form FROM (SELECT doc_id, page, {heading_form('text')} AS form FROM ({S.CORPUS})) WHERE form IS NOT NULL"
    o["label_value_split"] = (
        f"SELECT doc_id, page, regexp_extract(text, {q(H.LABEL_VALUE)}, 1) AS label, {S.label_content('text')} AS content FROM ({S.CORPUS})"
    )
    o["heading_window_filter"] = strict_found() + (
        f" SELECT doc_id, page, category, ordinal, match_no, value, context, {S.heading('context')} AS in_heading FROM kept"
    )
    html = f"WITH src AS (SELECT *, {S.NORM} AS norm FROM ({S.HTML}))"
    o["sensitive_flag"] = f"{html} SELECT doc_id, kind FROM (SELECT doc_id, {S.SECONDARY_KIND} AS kind FROM src) WHERE kind IS NOT NULL"
    o["sensitive_flag_minimal"] = f"{html} SELECT doc_id, {S.first_kind('text', SECONDARY_MINIMAL)} IS NOT NULL AS sensitive FROM src"
    # ---- detection cells
    for c in C.REDACT_CELLS:
        o[f"{C.CELL_NAMES[c]}_redact"] = corpus(category_patterns("redact", c, C.MASK)) + f" SELECT {ITEM} FROM ({S.ITEMS})"
    for c in C.SCAN_CELLS:
        o[f"{C.CELL_NAMES[c]}_scan"] = corpus(category_patterns("scan", c, C.MASK)) + f" SELECT {ITEM} FROM found"
    for c in C.STRICT_CELLS:
        o[f"{C.CELL_NAMES[c]}_strict"] = strict_found([c]) + f" SELECT {ITEM} FROM kept WHERE {STRICT_KEEP}"
        o[f"{C.CELL_NAMES[c]}_lang"] = lang_found([c]) + f" SELECT {ITEM} FROM found"
    for c in C.TEXT_CELLS:
        head, last, joined = text_items(c)
        o[f"{C.CELL_NAMES[c]}_text"] = (
            f"{head} SELECT doc_id, CAST(generate_subscripts({joined}, 1) - 1 AS INTEGER) AS item_no, unnest({joined}) AS value FROM {last}"
        )
    intl = category_patterns("redact", "phone")[:1]
    codes = CALLING_ONE + CALLING_TWO + [z + str(d) for z in CALLING_ZONES for d in range(10)]
    dim = "(VALUES " + ", ".join(f"({q(c)})" for c in codes) + ") AS codes(code)"
    intl_sql = corpus(intl, validate=False) + (
        f", numbers AS (SELECT doc_id, page, match_no, value, code FROM found, {dim} "
        "WHERE starts_with(regexp_replace(value, '[^0-9]', '', 'g'), code))"
    )
    o["phone_intl"] = intl_sql + " SELECT doc_id, page, match_no, value, code FROM numbers"
    custom = [Pattern("custom", 0, 1, C.MASK_REGEX, True)]
    custom_sql = (
        f"WITH src AS MATERIALIZED (SELECT *, {S.NORM} AS norm FROM ({S.CORPUS})), "
        f"ms AS (SELECT doc_id, page, text, regexp_extract_all(norm, {q('(?i)' + C.MASK_REGEX)}) AS ms, "
        f"string_split_regex(norm, {q('(?i)' + C.MASK_REGEX)}) AS pieces FROM src), "
        "k AS (SELECT *, unnest(ms) AS value, generate_subscripts(ms, 1) AS k FROM ms), "
        "s AS (SELECT doc_id, page, value, list_sum(list_transform(pieces[1:k], lambda x: len(x))) + "
        "coalesce(list_sum(list_transform(ms[1:k-1], lambda x: len(x))), 0) AS s FROM k)"
    )
    assert custom[0].java
    o["mask_regex"] = custom_sql + (
        f" SELECT doc_id, page, 'Custom Pattern' AS type, value AS \"match\", CAST(s AS INTEGER) AS start, "
        f"CAST(s + len(value) AS INTEGER) AS \"end\", repeat('█', len(value)) AS mask FROM s WHERE NOT {S.heading('value')}"
    )
    word = f"regexp_extract_all({S.NORM}, {q('(?i)' + C.WORD_REGEX)})"
    o["pattern_match"] = (
        f"SELECT doc_id, page, CAST(len(ms) AS INTEGER) AS n, array_to_string(ms, '|') AS items FROM (SELECT doc_id, page, {word} AS ms FROM ({S.DOC_PAGES}))"
    )
    groups = []
    for name, regexes in SECONDARY_GROUPS.items():
        for r in regexes:
            source = "norm" if r.startswith("\\b") else "text"
            groups.append(f"SELECT doc_id, page, {q(name)} AS \"group\", unnest(regexp_extract_all({source}, {q('(?i)' + r)})) AS value FROM src")
    secondary = f"SELECT DISTINCT doc_id, page, \"group\", value FROM ({' UNION ALL '.join(groups)})"
    o["secondary_text_scan"] = f"{html} {secondary}"
    o["findings_redact"] = S.with_spans(S.CORPUS, REDACT) + f" SELECT {FINDING}, start, \"end\" FROM found"
    o["findings_scan"] = corpus(SCAN) + f" SELECT {FINDING} FROM found"
    o["findings_strict"] = strict_found() + f" SELECT {FINDING} FROM kept WHERE {STRICT_KEEP}"
    o["findings_lang"] = lang_found() + f" SELECT {FINDING} FROM found"
    head, last, _ = text_items("phone")
    parts = []
    for c in TEXT_ORDER:
        joined = text_items(c)[2]
        parts.append(
            f"SELECT doc_id, {q(c)} AS category, CAST(generate_subscripts({joined}, 1) - 1 AS INTEGER) AS item_no, unnest({joined}) AS value FROM {last}"
        )
    o["findings_text"] = f"{head} {' UNION ALL '.join(parts)}"
    # ---- scalar functions
    for name, c in (("luhn", "credit_card"), ("aadhaar", "aadhaar"), ("iban", "iban"), ("bic", "bic"), ("pan", "pan")):
        key = {"luhn": "luhn_valid", "aadhaar": "verhoeff_valid"}.get(name, f"{name}_valid")
        o[key] = corpus(category_patterns("redact", c), validate=False) + (
            f" SELECT doc_id, value, {S.CHECK[name]('value')} AS valid FROM (SELECT DISTINCT doc_id, value FROM found)"
        )
    o["normalise_value"] = corpus(REDACT, validate=False) + (
        " SELECT doc_id, category, value, CASE WHEN category IN ('iban', 'bic') THEN upper(regexp_replace(value, '\\s+', '', 'g')) "
        "WHEN category = 'pan' THEN upper(regexp_replace(value, '[-\\s]', '', 'g')) ELSE regexp_replace(value, '[-\\s]', '', 'g') END AS normalised "
        "FROM (SELECT DISTINCT doc_id, category, value FROM found)"
    )
    whole = S.with_spans(S.whole(S.CORPUS_DOCS), REDACT)
    o["match_spans"] = whole + " SELECT doc_id, category, ordinal, match_no, value, start, \"end\" FROM found"
    o["context_window"] = whole + f" SELECT doc_id, category, ordinal, match_no, value, {S.context(20)} AS context FROM found"
    o["escape_literal"] = (
        "SELECT p_partkey, literal, '\\b\\Q' || replace(literal, '\\E', '\\E\\\\E\\Q') || '\\E\\b' AS regex FROM ("
        "SELECT p_partkey, p_name || '+\\E(1)' AS literal FROM part)"
    )
    o["mask_chars"] = corpus(category_patterns("redact", "credit_card"), validate=False) + (
        " SELECT doc_id, value, repeat('*', len(value)) AS mask FROM (SELECT DISTINCT doc_id, value FROM found)"
    )
    # ---- masking
    o["redact_block"] = masked() + " SELECT doc_id, page, text FROM masked"
    o["redact_blur"] = masked("*", preserve=False) + " SELECT doc_id, page, text FROM masked"
    o["redact_folded"] = corpus(REDACT, S.whole(S.CORPUS_DOCS)) + S.folded()
    for key, c in (("cc", "credit_card"), ("phone", "phone"), ("email", "email"), ("masked", "mask")):
        head, last = text_job(S.CORPUS_DOCS, text_steps([c]))
        o[f"redact_token_{key}"] = f"{head} SELECT doc_id, text FROM {last}"
    head, last = text_job(S.CORPUS_DOCS, text_steps())
    o["redact_text_pipeline"] = f"{head} SELECT doc_id, text FROM {last}"
    o["redact_document_pipeline"] = masked(mask=C.MASK) + " SELECT doc_id, page, text FROM masked"
    o["drop_sensitive_text"] = (
        f"{html} SELECT doc_id, CASE WHEN {S.SECONDARY_KIND} IS NOT NULL THEN repeat('█', len(text)) ELSE text END AS text FROM src"
    )
    # ---- joins
    table = profile_patterns("text", ["phone", "credit_card"])
    rows = [Pattern(p.category, 0, i, p.regex, p.ignore_case) for i, p in enumerate(table, 1)]
    o["pages_x_patterns"] = corpus(rows) + " SELECT doc_id, page, ordinal AS pattern_id, match_no, value FROM found"
    o["pattern_table_large"] = (
        "WITH words AS MATERIALIZED (SELECT w, CAST(row_number() OVER (ORDER BY w) AS INTEGER) AS pattern_id FROM ("
        "SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{7,}')) AS w FROM documents) QUALIFY pattern_id <= 5000), "
        # A match ends a run of letters: it is a suffix of the run, and the word is that suffix without "s" or "es".
        f"runs AS (SELECT doc_id, page, unnest(rs) AS r, generate_subscripts(rs, 1) AS no FROM (SELECT doc_id, page, regexp_extract_all(text, '[a-z]+[,.]') AS rs FROM ({S.DOC_PAGES}))), "
        "ends AS (SELECT doc_id, page, no, substr(r, CAST(i AS INT)) AS value FROM (SELECT *, unnest(range(1, len(r) - 6)) AS i FROM runs)), "
        "stems AS (SELECT *, left(value, -1) AS w FROM ends UNION ALL SELECT *, left(value, -2) FROM ends WHERE left(value, -1) LIKE '%s' "
        "UNION ALL SELECT *, left(value, -3) FROM ends WHERE left(value, -1) LIKE '%es') "
        "SELECT doc_id, page, pattern_id, CAST(row_number() OVER (PARTITION BY doc_id, page, pattern_id ORDER BY no) - 1 AS INTEGER) AS match_no, value FROM stems JOIN words USING (w)"
    )
    o["doc_matches_to_pages"] = corpus(REDACT) + (
        f" SELECT DISTINCT s.doc_id, s.page, t.hide FROM src s JOIN ({S.targets()}) t ON s.doc_id = t.doc_id "
        f"WHERE contains(s.text, t.hide) AND NOT {S.heading('t.value', 's.lang')}"
    )
    sets = ", ".join(f"({q(k)}, {q(c)}, {len(r)})" for k, cells in LANG.items() for c, r in cells.items())
    o["lang_pattern_lookup"] = (
        "SELECT doc_id, d.lang, set_lang, category, CAST(n AS BIGINT) AS n_patterns FROM ("
        "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'hi' ELSE lang END AS lang FROM documents) d "
        f"JOIN (VALUES {sets}) AS p(set_lang, category, n) ON p.set_lang = CASE WHEN d.lang IN ('en', 'hi') THEN d.lang ELSE 'en' END"
    )
    words = " ".join(f"WHEN {q(k)} THEN {len(w)}" for k, w in H.HEADING_WORDS.items())
    o["lang_heading_lookup"] = (
        "SELECT doc_id, lang, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'en' END AS label_lang, "
        "CASE WHEN lang IN ('en', 'hi', 'fr', 'de', 'es') THEN lang ELSE 'en' END AS word_lang, "
        f"CAST(CASE lang {words} ELSE {len(H.HEADING_WORDS['en'])} END AS INTEGER) AS n_words FROM ("
        "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'hi' WHEN 1 THEN 'it' ELSE lang END AS lang FROM documents)"
    )
    o["lang_memo_join"] = language(S.DOC_PAGES) + " SELECT doc_id, page, lang FROM detected"
    o["unredacted_semi_join"] = REMASKED + f" SELECT DISTINCT doc_id FROM ({S.hits(VERIFY, 'again', False)})"
    o["category_dim_left_join"] = phrase_counts(corpus(REDACT)) + (
        f" SELECT d.doc_id, dim.category, dim.label, coalesce(n_items, 0) AS n_items FROM ({S.CORPUS_DOCS}) d CROSS JOIN {S.LABELS} "
        "LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.category = dim.category"
    )
    # ---- aggregates, distinct, windows
    per_page = ", ".join(f"len({S.extract(p)})" for p in profile_patterns("scan"))
    o["count_per_page"] = f"WITH src AS (SELECT *, {S.NORM} AS norm FROM ({S.CORPUS})) SELECT doc_id, page, concat_ws(',', {per_page}) AS counts FROM src"
    counts = phrase_counts(corpus(REDACT))
    o["count_per_category"] = counts + " SELECT doc_id, category, n_items FROM counts"
    o["total_items"] = counts + (
        " SELECT doc_id, category, CAST(sum(n_items) AS BIGINT) AS total_items FROM counts GROUP BY GROUPING SETS ((doc_id), (category), ())"
    )
    o["sensitivity_summary"] = corpus(SCAN) + (
        f", html AS (SELECT *, {S.NORM} AS norm FROM ({S.HTML})), sec AS ({secondary.replace('FROM src', 'FROM html')}), "
        "img AS (SELECT count(*) AS items, sum(n) AS vals FROM (SELECT doc_id, page, count(*) AS n FROM sec GROUP BY doc_id, page)) "
        "SELECT category, count(*) AS n_findings FROM found GROUP BY category UNION ALL SELECT 'images', items FROM img WHERE items > 0 "
        "UNION ALL SELECT 'total', CAST((SELECT count(*) FROM found) + items + coalesce(vals, 0) AS BIGINT) FROM img"
    )
    o["nonzero_categories"] = counts + (
        " SELECT doc_id, CAST(sum(n_items) AS BIGINT) AS total_items, string_agg(n_items || ' ' || lower(label), ', ' ORDER BY c.category) AS phrase "
        f"FROM counts c JOIN {S.LABELS} ON dim.category = c.category GROUP BY doc_id"
    )
    o["doc_target_list"] = corpus(REDACT) + (
        " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cat_no, ordinal, page, match_no) AS position, value, hide "
        f"FROM ({S.targets()})"
    )
    ordered = profile_patterns("redact", ["phone", "aadhaar", "pan"])
    o["distinct_ordered"] = corpus(ordered) + f" SELECT doc_id, category, value, ordinal, page, match_no FROM ({S.FIRST})"
    sets_ = profile_patterns("redact", ["credit_card", "cvv", "expiry", "bic", "iban"])
    o["distinct_set"] = corpus(sets_) + " SELECT DISTINCT doc_id, category, value FROM found"
    regexes = [p for p in category_patterns("redact", "phone") if p.ordinal > 0]
    o["union_matches"] = intl_sql + (
        " SELECT doc_id, page, value, 'library' AS origin FROM numbers UNION ALL "
        f"SELECT doc_id, page, value, 'regex' AS origin FROM ({S.hits(regexes)})"
    )
    o["recommendation"] = corpus(SCAN) + (
        " SELECT doc_id, count(*) AS total_items, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM found GROUP BY doc_id"
    )
    o["first_seen_rank"] = corpus(REDACT) + (
        f" SELECT doc_id, category, value, row_number() OVER (PARTITION BY doc_id, category ORDER BY ordinal, page, match_no) AS position FROM ({S.FIRST})"
    )
    o["first_category"] = corpus(REDACT) + " SELECT doc_id, arg_min(category, cat_no) AS category FROM found GROUP BY doc_id"
    o["lang_top1"] = language(S.whole(S.DOCS)) + " SELECT doc_id, page, lang FROM best"
    text_patterns = [category_patterns("text", c) for c in TEXT_ORDER]
    o["last_pattern_wins"] = leftovers(f"WITH docs AS MATERIALIZED ({S.CORPUS_DOCS})", "docs", text_patterns)
    o["page_order"] = (
        "SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, "
        f"CAST(len(regexp_extract_all({S.NORM}, {q('(?i)' + chr(92) + 'b[a-z]+ing' + chr(92) + 'b')})) AS INTEGER) AS n "
        "FROM conversations ORDER BY doc_id, page"
    )
    # ---- verification
    o["verify_text"] = REMASKED + (
        f", left_over AS ({S.spans(VERIFY, 'again')}) SELECT doc_id, page, 'unredacted_text' AS type, category, ordinal, match_no, "
        f"{S.context(20)} AS context, value AS text FROM left_over"
    )
    words_sql = (
        ", words AS (SELECT doc_id, page, unnest(ws) AS text, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS word_no FROM ("
        "SELECT doc_id, page, regexp_extract_all(text, '\\S+') AS ws FROM masked)), "
        f"w AS MATERIALIZED (SELECT *, {S.NORM} AS norm FROM words) "
    )
    o["verify_words"] = masked() + words_sql + " UNION ALL ".join(
        f"SELECT doc_id, page, 'unredacted_word' AS type, '{p.category}' AS category, CAST({p.ordinal} AS INTEGER) AS ordinal, word_no, text "
        f"FROM w WHERE len({S.extract(p)}) > 0" for p in VERIFY
    )
    o["verify_summary"] = REMASKED + (
        f", issues AS (SELECT doc_id, count(*) AS n FROM ({S.hits(VERIFY, 'again', False)}) GROUP BY doc_id) "
        f"SELECT d.doc_id, coalesce(n, 0) AS n_issues, n IS NULL AS success FROM ({S.CORPUS_DOCS}) d LEFT JOIN issues i ON i.doc_id = d.doc_id"
    )
    minimal = S.first_kind("text", SECONDARY_MINIMAL)
    o["verify_secondary"] = (
        f"{html}, dropped AS (SELECT doc_id, page, CASE WHEN {minimal} IS NOT NULL THEN repeat('█', len(text)) ELSE text END AS text FROM src), "
        f"again AS MATERIALIZED (SELECT *, {S.NORM} AS norm FROM dropped) " + " UNION ALL ".join(
            f"SELECT doc_id, page, 'unredacted_image_text' AS type, '{p.category}' AS category, CAST({p.ordinal} AS INTEGER) AS ordinal "
            f"FROM again WHERE len({S.extract(p)}) > 0" for p in VERIFY
        )
    )
    head, last = text_job(S.CORPUS_DOCS, text_steps())
    masked_text = [category_patterns("text", c, C.MASK) for c in TEXT_ORDER]
    o["verify_text_pipeline"] = leftovers(head, last, masked_text)
    # ---- language
    o["lang_profiles"] = language(S.whole(S.DOCS)) + " SELECT lang, gram, CAST(weight AS INTEGER) AS weight FROM profile"
    o["lang_detect"] = language(S.whole(S.DOCS)) + " SELECT doc_id, page, lang FROM detected"
    o["lang_route"] = language(S.whole(S.DOCS)) + (
        " SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fr' ELSE 'auto' END AS requested, CASE WHEN doc_id % 3 = 0 THEN 'fr' ELSE lang END AS language FROM detected"
    )
    head, last = text_job(S.DOCS, text_steps())
    o["stream_redact"] = f"{head} SELECT doc_id, text FROM {last}"
    labelled = r"\bIBAN\s*:?\s*[A-Z]{2}[0-9]{2}[0-9A-Z]{10,30}\b"
    o["iban_labelled"] = (
        f"WITH t AS (SELECT o_orderkey AS doc_id, {C.LABELLED_IBAN} AS text FROM orders) "
        f"SELECT doc_id, 'found' AS kind, CAST(2 AS INTEGER) AS ordinal, unnest(regexp_extract_all(text, {q('(?i)' + labelled)})) AS value FROM t UNION ALL "
        f"SELECT doc_id, 'left', CAST(2 AS INTEGER), unnest(regexp_extract_all(text, {q(labelled)})) FROM t"
    )
    o["stream_counts"] = o["stream_counts_compacted"] = o["count_per_category"]
    o["stream_pages"] = o["redact_block"]
    o["page_job"] = (
        f"SELECT d.doc_id, coalesce(n_findings, 0) AS n_findings, coalesce(n_items, 0) AS n_items, coalesce(n_hidden, 0) AS n_hidden, "
        f"coalesce(a, 0) + coalesce(b, 0) AS n_issues, coalesce(a, 0) + coalesce(b, 0) = 0 AS success FROM ({S.CORPUS_DOCS}) d "
        f"LEFT JOIN (SELECT doc_id, count(*) AS n_findings FROM ({o['findings_redact']}) GROUP BY doc_id) f USING (doc_id) "
        f"LEFT JOIN (SELECT doc_id, CAST(sum(n_items) AS BIGINT) AS n_items FROM ({o['count_per_category']}) GROUP BY doc_id) c USING (doc_id) "
        f"LEFT JOIN (SELECT doc_id, CAST(sum(len(text) - len(replace(text, '█', ''))) AS BIGINT) AS n_hidden FROM ({o['redact_block']}) GROUP BY doc_id) m USING (doc_id) "
        f"LEFT JOIN (SELECT doc_id, count(*) AS a FROM ({o['verify_text']}) GROUP BY doc_id) t USING (doc_id) "
        f"LEFT JOIN (SELECT doc_id, count(*) AS b FROM ({o['verify_words']}) GROUP BY doc_id) w USING (doc_id)"
    )
    return o
