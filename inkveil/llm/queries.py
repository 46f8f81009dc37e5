"""The registered queries of the corpus operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import collocations, decontam, langid, lexical, licenses, packing, personal, secrets, sharding, simhash, spotsigs, tokens, urls
from inkveil.llm.common import table

URL_RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan_documents(table(spark, sf_dir, "documents"))
    count = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    text = secrets.listed("spans")
    counts = [F.when(F.col("spans").isNull(), F.lit(0)).otherwise(count(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secrets.RULES]
    return rows.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    one = lambda x: F.concat_ws(":", x["license"], x["begin"].cast("string"), x["end"].cast("string"))
    return rows.select(
        "doc_id", F.col("_found.n_words").alias("n_words"), F.size("_found.licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("_found.licenses", one), ",").alias("licenses"),
        F.coalesce(F.array_max("_found.licenses.coverage"), F.lit(0.0)).alias("coverage"),
    )


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.select("doc_id", langid.held_out().alias("held_out"), "_language.lang_pred", "_language.score")


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def sharding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", F.col("_found.n_words").alias("n_words"), decontam.n_hit().alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ","), 256).alias("items_sha256"),
        (F.size("_found.hits") > 0).alias("contaminated"),
    )


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    rows = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return rows.select("page_id", "host", "path", "rule", "verdict")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_found.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = personal.listed(personal.ordered("_found.base"))
    return rows.select(
        "doc_id", *[count(k) for k in personal.KINDS], F.sha2(base, 256).alias("base_sha256"),
        personal.listed(personal.ordered("_found.base", "_found.added")).alias("spans"),
        F.size("_found.added").cast("long").alias("n_added"),
    )


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collocations.ranked(collocations.collocations(table(spark, sf_dir, "documents")))
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    "op1_secret_scan": secret_scan,
    "op2_license_scan": license_scan,
    "op3_document_fingerprints": document_fingerprints,
    "op4_best_fit_packing": best_fit_packing,
    "op5_language_id": language_id,
    "op6_simhash_groups": simhash_groups,
    "op7_token_output": token_output,
    "op8_sharding": sharding_plan,
    "op9_decontamination": decontamination,
    "op10_url_filter": url_filter,
    "op11_personal_data": personal_data,
    "op12_lexical_search": lexical_search,
    "op13_phrase_collocations": phrase_collocations,
}

_ASSIGN = secrets.ASSIGN.replace("'", "''")

ORACLES = {
    # Starts are the lengths of what stands before: gaps between matches and the matches themselves.
    "op1_secret_scan": rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
m as (
  select r, 'assign' as kind, 0 as rank, 12 as least, regexp_extract_all(text, '{_ASSIGN}') as hits,
         regexp_extract_all(text, '{_ASSIGN}', 1) as vals, string_split_regex(text, '{_ASSIGN}') as gaps from t
  union all select r, 'access', 1, 18, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') from t
  union all select r, 'hex', 2, 16, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') from t),
u as (select r, kind, rank, least, unnest(range(1, len(hits) + 1)) as i, hits, vals, gaps from m),
w as (select r, kind, rank, least, i, hits[i] as hit, vals[i] as val, length(hits[i]) as n, length(gaps[i]) as g from u),
p as (select *, sum(g) over o + sum(n) over o - n as begin from w window o as (partition by r, kind order by i)),
f as (select r, kind, rank, begin::bigint as begin, (begin + n)::bigint as fin from p where length(val) >= least),
a as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             string_agg(kind || ':' || begin || ':' || fin, ',' order by begin, rank) as spans from f group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from t left join a using (r)""",
    # CRC-32 by table over the bytes of the text; shards by exact sums in the order of the key.
    "op8_sharding": r"""
with crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[],
               lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
t as (select r, doc_id, strlen(text)::bigint + 1 as size, substr(sha256(text), 1, 16) as k,
             list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::ubigint) as b from d),
c as (select t.*, xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda c, x: xor(c >> 8, crc.t[1 + (xor(c, x) & 255)::bigint])), 4294967295)::bigint as text_crc32
      from t, crc),
p as (select *, sum(size) over (order by k, doc_id nulls first, r) - size as before, sum(size) over () as total from c),
s as (select *, (((2 * before + size) * 16) // (2 * total))::int as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard,
       row_number() over (partition by shard order by k, doc_id nulls first, r) - 1 as slot, null::int as grown_shard
from s""",
    "op9_decontamination": r"""
with d as (select row_number() over () as r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select coalesce(item_id::varchar, 'null') as item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
v as (select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as x
      from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from v),
s as (select r, n, w, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
h as (select s.r, s.i, s.n, v.item from (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as x from s) s join v on s.x = v.x and s.n = v.n),
places as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from h) group by r),
names as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (r) left join names using (r)""",
    "op10_url_filter": r"""
with t as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages)
select page_id, host, path,
       case when ('.' || host) like '%.example.org' and starts_with(path, '/en/1') then 'example.org/en/1'
            when ('.' || host) like '%.example.org' and starts_with(path, '/es/') then 'example.org/es/'
            when ('.' || host) like '%.com' and starts_with(path, '/fr/') then 'com/fr/'
            when ('.' || host) like '%.com' and starts_with(path, '/de/') then 'com/de/'
            when ('.' || host) like '%.org' and starts_with(path, '/') then 'org/' end as rule,
       case when ('.' || host) like '%.example.org' and (starts_with(path, '/en/1') or starts_with(path, '/es/')) then 'block'
            when ('.' || host) like '%.com' and starts_with(path, '/de/') then 'block' else 'allow' end as verdict
from t""",
    "op12_lexical_search": r"""
with lowered as (select row_number() over () as r, doc_id,
                        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
d as (select r, doc_id, w, len(w)::bigint as n from lowered where len(w) > 0),
corpus as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from d),
items as (select row_number() over () as i, item_id,
                 list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark),
asked as (select i, item_id, unnest(w) as term from items),
tf as (select r, term, count(*)::bigint as tf from (select r, unnest(w) as term from d) where term in (select term from asked) group by r, term),
weights as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from tf, corpus group by term, big_n),
gains as (select r, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))) as gain
          from tf join weights using (term) join d using (r), corpus),
scores as (select i, item_id, r, sum(gain)::bigint as score from asked join gains using (term) group by i, item_id, r having sum(gain) > 0),
ranked as (select item_id, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls first, r)::int as rank from scores join d using (r))
select item_id, rank, doc_id, score from ranked where rank <= 50""",
    "op13_phrase_collocations": r"""
with pieces as (select coalesce(lang, 'und') as lang,
                       unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
runs as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
          from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from runs, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k)),
f as (select lang, k, phrase, count(*)::bigint as n from grams group by lang, k, phrase),
totals as (select lang, sum(n)::bigint as n from f where k = 1 group by lang),
often as (select lang, k, phrase, n, string_split(phrase, ' ') as w from f where n >= 30),
inside as (select lang, phrase, max(n) as longer from (
             select lang, n, array_to_string(w[i : i + m - 1], ' ') as phrase
             from (select lang, n, w, m, unnest(range(1, k - m + 2)) as i from often, (select unnest([2, 3]) as m) where k > m)) group by lang, phrase),
candidates as (select o.* from often o left join inside using (lang, phrase) where k >= 2 and (longer is null or 100::hugeint * longer < 80::hugeint * n)),
cuts as (select lang, phrase, n as a, cut, array_to_string(w[1 : cut], ' ') as p, array_to_string(w[cut + 1 :], ' ') as q
         from (select *, unnest(range(1, k)) as cut from candidates)),
scored as (select c.lang, c.phrase, a, cut, x.n as l, y.n as r, ((2000000::hugeint * a) // (x.n + y.n))::bigint as score
           from cuts c join often x on x.lang = c.lang and x.phrase = p join often y on y.lang = c.lang and y.phrase = q),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, totals.n as n, score
from best join totals using (lang) qualify rank <= 2000""",
}
