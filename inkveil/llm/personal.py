"""Personal data: e-mail addresses, IP addresses, card and phone numbers.

Patterns give the base spans, each kind by itself, leftmost and not overlapping.  A conditional random field over word shapes
(:mod:`.crf`), trained from a small labelled table, adds what the patterns miss: values written around the patterns ("name at
host dot org", "10[.]0[.]0[.]1", a number without its plus sign behind the word for phone) and values that a pattern ran
together with their neighbours and lost (a phone number before an address, two cards in a row).  An added span passes the
checks of its kind (an address after "at" and "dot" are read as signs, parts up to 255, 13 to 19 digits and Luhn, 9 to 15
digits) and overlaps no base span.  Lines that hold neither a digit nor a sign for "at" cannot hold such a span and are not
decoded.

The work is row by row in Arrow batches; nothing is shuffled.  All patterns are linear in the text.

Nulls and odd input: a null text is the empty text and has no spans; rows are judged one by one, so null, tied and repeated
doc_ids stay as they are; an empty table gives no rows; a line of any length is decoded, in sequences of up to 256 tokens;
other columns are kept, but for one named ``_found``, which the result replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import crf
from inkveil.llm.common import python_tasks

KINDS = crf.KINDS
FOUND = "struct<base:array<struct<kind:string,begin:int,end:int>>,added:array<struct<kind:string,begin:int,end:int>>>"
#: Rows of a labelled table; more are an error, as training runs on the driver.
MOST_LABELLED = 5000

# The signs of addresses and numbers.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WHOLE_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_AT = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s*@\s*", re.IGNORECASE)
_DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\s*\.\s*", re.IGNORECASE)
#: What a line must hold for any added span.
_CUE = re.compile(r"[0-9@]|[\s\[({<]at[\s\])}>]", re.IGNORECASE)

#: The labelled table: values stand in brackets behind their kind.
LABELLED = tuple("""
Please write to [email|anna.miller@example.com] before Monday.
Contact: [email|j.smith at mail dot example dot org] or come by.
Mail me, [email|bob(at)site(dot)net], for the files.
You reach us under [email|info [at] firma [dot] de] at any time.
Schreiben Sie an [email|k.meier at post dot de] oder rufen Sie an.
Escriba a [email|maria at correo dot es] para saber más.
Écrivez à [email|paul.durand at poste dot fr] avant lundi.
Send it to [email|sales at shop dot example dot com], thanks.
email [email|first.last at uni dot edu] phone [phone|+1 (212) 555-0187]
my address is [email|li99 @ host . com] since May
The mail [email|x_y{at}lab{dot}io] is old.
He looked at the dot on the map at noon.
We met at home. Dot was there at two.
They stay at 12 Main Street at night.
at the end of the day. At 5 we left.
La casa está at the corner dot.
Server [ip|10.20.30.40] is down, use [ip|10.20.30.41] instead.
The host [ip|192[.]168[.]7[.]12] answered the ping.
Blocked [ip|203(.)0(.)113(.)9] in the firewall log.
Address [ip|172 . 16 . 4 . 250] is free.
connect to [ip|8 dot 8 dot 4 dot 4] for names
login from [ip|198.51.100.23] failed 3 times
Von [ip|85[.]214[.]1[.]2] kamen 40 Anfragen.
desde [ip|190.1.2.3] a las 10:30
Version 4.0.1 of the license, section 2.3.
Licensed under CC BY-NC 4.0.
See chapters 1.2.3 and 4.5.6 of the book.
The ratio was 3.14 and then 2.72 in 1999.
under the terms of version 2.0 or version 3.
release 10.2 build 4521 of 2021
Pay with [card|4111 1111 1111 1111] today.
Card [card|5500-0055-5555-5559] was charged.
My card is [card|4111.1111.1111.1111] and it works.
two cards [card|4012888888881881] [card|5105105105105100] on file
the numbers [card|6011111111111117] [card|4222222222222] were stolen
Karte [card|4000 0566 5566 5556] ist gesperrt.
la tarjeta [card|5555.5555.5555.4444] ha caducado
carte bancaire [card|4242/4242/4242/4242] refusée
card: [card|3782 822463 10005], exp 04/27
then [card|4917610000000000] and so on
paid by [card|30569309025904] in full
Order 20210045 was shipped with 12 items.
Invoice 4711 of 2020-03-15 is open.
The code 98457120945 has no meaning.
id 1234567890123456789012 in the table
In 1848 and 1914 things changed, 300 people came.
token = "04dbebab91ab85687d33eeaaf9ac699e"
key 9f86d081884c7d65 hash 2c26b46b68ffc68f
He counted 1, 2, 3, 4 and 5 of 100.
between 1000 and 2000 or 10 000 000 in all
Call [phone|+1 (743) 555-3824] now.
Tel. [phone|(212) 555-0147] after six.
phone [phone|212-555-0199] or fax [phone|212-555-0188]
Phone: [phone|020 7946 0958] in London.
Tel: [phone|030 901820 44] Berlin
ring me on [phone|+44 20 7946 0991] tomorrow
[phone|+1 (826) 555-4081] [ip|190.137.223.204] was the last entry
from [ip|190.137.223.204] [phone|+1 (310) 555-4510] he called
[phone|+1 (017) 555-7713] [card|4539578763621486] are in the file
of [phone|+1 (152) 555-8590] [phone|+1 (279) 555-0216] the first is right
my number is [phone|0049 30 12345678] at work
Telefon [phone|0171 2345678 90] ab acht Uhr
Teléfono [phone|(341) 555-0123] de la casa
téléphone [phone|01 42 68 53 00 12] le matin
call [phone|001.212.555.0143] collect
cell [phone|917.555.0162], home [phone|718.555.0177]
mobile [phone|(646) 555 0123] or mail [email|ed at site dot org]
reach him under phone [phone|303 555 0143] in the evening
The score was 21-17 and 21-19 in 2016.
On 12-05-2019 at 10:15 we met 40 guests.
From 555 to 600 pages, (123) notes.
ISBN 978-3-16-148410-0 is a book.
Part 123-456-78 of the list, line 9.
Lot 2020-11-30-44 went for 900.
### 5927243074273351!! of it.
the and of 12 on 34 in 56 to 78.
Es waren 35 Leute und 12 Hunde da.
En 1990 llegaron 400 personas de 12 pueblos.
Il y a 365 jours et 12 mois.
""".strip().splitlines())


def marked(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Text and spans of a line of the labelled table."""
    text, spans = "", []
    for part in re.split(r"(\[(?:" + "|".join(KINDS) + r")\|(?:[^\[\]]|\[(?:at|dot|\.)\])*\])", line):
        kind, bar, value = part[1:-1].partition("|")
        if part[:1] == "[" and bar and kind in KINDS:
            spans.append((len(text), len(text) + len(value), kind))
            text += value
        else:
            text += part
    return text, spans


def labelled_table(spark: SparkSession) -> DataFrame:
    """The small labelled table, ``text`` and ``spans(begin, end, kind)``."""
    return spark.createDataFrame([marked(x) for x in LABELLED], "text string, spans array<struct<begin:int,end:int,kind:string>>")


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> crf.Model:
    """A field fitted to at most ``most`` labelled rows (``text``, ``spans``), in the order of the texts."""
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), "spans").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labelled rows")
    lines = sorted((r["text"], sorted((s["begin"], s["end"], s["kind"]) for s in r["spans"] or [])) for r in rows)
    if not any(text.strip() for text, _ in lines):
        raise ValueError("no labelled text")
    return crf.train(lines)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def _is_card(value: str) -> bool:
    digits = _digits(value)
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _parts_fit(parts: list[str]) -> bool:
    short = [p.lstrip("0") or "0" for p in parts]
    return all(len(p) <= 3 and int(p) <= 255 for p in short)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, begin, end) of the pattern matches that pass their checks, by kind and place."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        if host:
            begin = at
            while begin > after and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                out.append((0, begin, host.end()))
                after = host.end()
        at = text.find("@", at + 1)
    out += [(1, *m.span()) for m in _IP.finditer(text) if _parts_fit(m[0].split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def holds(kind: int, value: str) -> bool:
    """The check of an added span."""
    if kind == 0:
        return _WHOLE_MAIL.fullmatch(_DOT.sub(".", _AT.sub("@", value))) is not None
    if kind == 1:
        parts = re.split(r"\s*[\[({<]?\s*(?:\.|dot)\s*[\])}>]?\s*", value)
        return len(parts) == 4 and all(re.fullmatch("[0-9]+", p) for p in parts) and _parts_fit(parts)
    if kind == 2:
        return re.fullmatch(r"[0-9](?:[\x20./-]?[0-9])+", value) is not None and _is_card(value)
    return re.fullmatch(r"\+?[\x20().0-9/-]*[0-9]", value) is not None and 9 <= len(_digits(value)) <= 15


def _pieces(line: str) -> Iterator[list[tuple[int, int]]]:
    """Token places of a line in sequences; a long line is cut before a plain word."""
    places, begin = crf.tokens(line), 0
    while len(places) - begin > crf.LONGEST:
        end = begin + crf.LONGEST
        while end > begin + crf.LONGEST // 2 and not (line[places[end][0]].isalpha() and line[slice(*places[end])].lower() not in ("at", "dot")):
            end -= 1
        if end == begin + crf.LONGEST // 2:
            end = begin + crf.LONGEST
        yield places[begin:end]
        begin = end
    if begin < len(places):
        yield places[begin:]


class Finder:
    """Both sorts of spans of texts; made once in a task."""

    def __init__(self, model: crf.Model):
        self.model = model
        self.known: dict[str, int] = {}

    def class_of(self, token: str) -> int:
        code = self.known.get(token)
        if code is None:
            if len(self.known) > 200_000:
                self.known.clear()
            code = self.known[token] = self.model.class_of(token)
        return code

    def added(self, texts: list[str], bases: list[list]) -> list[list[tuple[int, int, int]]]:
        sequences, homes = [], []
        for i, text in enumerate(texts):
            if not _CUE.search(text):
                continue
            begin = 0
            for line in text.split("\n"):
                if _CUE.search(line):
                    for places in _pieces(line):
                        words, glued = crf.sequence_of(line, places)
                        sequences.append(([self.class_of(w) for w in words], glued))
                        homes.append((i, begin, places))
                begin += len(line) + 1
        out: list[list] = [[] for _ in texts]
        for (i, offset, places), labels in zip(homes, crf.decode(self.model, sequences)):
            for kind, first, last in crf.spans_of(labels):
                begin, end = offset + places[first][0], offset + places[last][1]
                if not any(b < end and begin < e for _, b, e in bases[i]) and holds(kind, texts[i][begin:end]):
                    out[i].append((kind, begin, end))
        return [sorted(x) for x in out]

    def __call__(self, texts: list[str], at_once: int = 4_000_000) -> list[tuple[list, list]]:
        out, held, size = [], [], 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= at_once or i == len(texts) - 1:
                bases = [base_spans(t) for t in held]
                out += zip(bases, self.added(held, bases))
                held, size = [], 0
        return out


def scan(docs: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """``docs`` with ``_found``: base and added spans, by kind as listed and place; code points, end exclusive."""
    spark = docs.sparkSession
    python_tasks(spark)
    held = spark.sparkContext.broadcast(model or train(labelled_table(spark)))

    @F.pandas_udf(FOUND)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder(held.value)
        named = lambda spans: [{"kind": KINDS[k], "begin": b, "end": e} for k, b, e in spans]
        for texts in parts:
            rows = finder([t or "" for t in texts])
            yield pd.DataFrame({"base": [named(b) for b, _ in rows], "added": [named(a) for _, a in rows]})

    return docs.withColumn("_found", found(docs["text"]))


def ordered(*lists: Column | str) -> Column:
    """All spans of the lists by kind as listed, then by place."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    spans = F.concat(*[F.col(x) if isinstance(x, str) else x for x in lists])
    keyed = F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("rank"), s["begin"].alias("begin"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
