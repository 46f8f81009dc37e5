"""Sources: tables and files of documents as rows of text pages.

The common shape is ``pages(doc_id BIGINT, page INT, text STRING, lang STRING)``
with ``page`` counted from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.sources.session import spread, spread_keys

MAX_UPLOAD_BYTES = 50 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_pages(documents: DataFrame, separator: str = "\n") -> DataFrame:
    """One row per page of ``documents(doc_id, text[, lang])``.

    ``separator`` is a regex; real page text uses form feed, the line tables use
    the line end.
    """
    rest = [c for c in ("lang",) if c in documents.columns]
    return documents.select(
        "doc_id", *rest, F.posexplode(F.split("text", separator, -1)).alias("page", "text")
    ).select("doc_id", (F.col("page") + 1).alias("page"), "text", *rest)


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the ``documents`` table, a line standing for a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return split_pages(spread(docs, "doc_id"))


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as one page per document (how plain-text files are read)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text", "lang")
    return spread(docs, "doc_id")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secondary text: raw markup of the ``pages`` table."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("text"))
    return spread(pages, "doc_id").withColumn("page", F.lit(1))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-page documents: a turn (from 0) is a page (from 1)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return spread(turns, "conv_id", "turn").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text"
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``notes(doc_id, text)``: one record per order with a value of every category."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return spread_keys(orders, "o_orderkey").selectExpr("o_orderkey AS doc_id", f"{NOTES_TEXT} AS text")


def note_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pages(notes(spark, sf_dir).withColumn("lang", F.lit("en")))


def note_id() -> Column:
    """Id of a note inside the corpus: below zero, so it meets no document id."""
    return -F.col("doc_id") - 1


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and notes as one page table; notes get the negative ids below zero."""
    return split_pages(_corpus(spark, sf_dir))


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and notes as one whole text per document."""
    return _corpus(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), "text", "lang")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, lang)`` of documents and notes, dealt once by ``doc_id``.

    Spark knows that the rows of a document lie in one partition and groups and joins by document without another shuffle;
    the texts of the notes are made behind it, so only their keys travel.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.lit(None).cast("long").alias("o_orderkey"), F.lit(False).alias("_note"))
    orders = table(spark, sf_dir, "orders").select(
        (-F.col("o_orderkey") - 1).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("en").alias("lang"), "o_orderkey", F.lit(True).alias("_note"))
    text = F.when(F.col("_note"), F.expr(NOTES_TEXT)).otherwise(F.col("text"))
    return spread_keys(docs.unionByName(orders), "doc_id").select("doc_id", text.alias("text"), "lang")


def written_otherwise(documents: DataFrame) -> DataFrame:
    """Three pages of each document: its text, the text in lower case with a line end for each blank, and broken after each 5."""
    forms = ["text", "lower(replace(text, ' ', chr(10)))", "replace(text, '5', concat('5-', chr(10), ' '))"]
    pages = F.array(*[F.struct(F.lit(i).alias("page"), F.expr(form).alias("text")) for i, form in enumerate(forms, 1)])
    return documents.select("doc_id", "lang", F.inline(pages))


# Text of one note; the same expression runs in Spark SQL and in DuckDB.
def _letter(factor: int) -> str:
    return f"chr(cast(65+(o_orderkey*{factor})%26 as int))"


def _digits(expr: str, width: int) -> str:
    return f"lpad(cast({expr} as string),{width},'0')"


NOTES_TEXT = "concat(" + ",chr(10),".join([
    f"'Phone: 555-',{_digits('o_orderkey%1000', 3)},'-',{_digits('(o_orderkey*7)%10000', 4)}",
    f"'Visa: 4532 0151 ',{_digits('o_orderkey%10000', 4)},' ',{_digits('(o_orderkey*13)%10000', 4)}",
    f"'CVV: ',{_digits('(o_orderkey*3)%1000', 3)}",
    f"'Expiry: ',{_digits('1+o_orderkey%12', 2)},'/',{_digits('24+o_orderkey%8', 2)}",
    f"'Aadhaar: ',{_digits('2000+o_orderkey%8000', 4)},' ',{_digits('(o_orderkey*17)%10000', 4)},' ',{_digits('(o_orderkey*31)%10000', 4)}",
    "'PAN: '," + ",".join(_letter(f) for f in (1, 3, 5, 7, 11)) + f",{_digits('(o_orderkey*19)%10000', 4)},{_letter(23)}",
    f"'IBAN: DE',{_digits('o_orderkey%97', 2)},{_digits('o_orderkey*104729', 18)}",
    "'BIC: '," + ",".join(_letter(f) for f in (1, 3, 5, 9)) + ",'DE'," + ",".join(_letter(f) for f in (15, 17)) + ",'XXX'",
]) + ")"


# ---------------------------------------------------------------- files ----

#: Encodings in the order in which they are tried.
CODECS = ("utf-8", "utf-16", "utf-16le", "utf-16be", "ascii", "iso-8859-1", "cp1252")
# Two bytes in hexadecimal that are a character by themselves, and pairs that are one together, by byte order.
_UNITS = {
    "LE": r"\G(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])",
    "BE": r"\G(?:(?:[0-9A-CEF].|D[0-7])..|D[89AB]..D[C-F]..)",
}
# Code page 1252 is ISO-8859-1 but for these bytes, of which five have no character.
_CP1252 = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_CP1252_HOLES = "^(?:..)*?(?:" + "|".join(f"{b:02X}" for b, c in _CP1252.items() if not c) + ")"


def _valid_utf16(content: Column, order: str) -> Column:
    """Whole characters only: an even number of bytes, and surrogates in pairs."""
    rest = F.regexp_replace(F.hex(content), F.lit(_UNITS[order]), F.lit(""))
    return (F.octet_length(content) % 2 == 0) & (rest == "")


def _codec(content: Column, name: str) -> tuple[Column, Column]:
    """Whether ``content`` is valid in an encoding, and its text."""
    if name == "utf-8":
        return F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")
    if name in ("utf-16le", "utf-16be"):
        order = name[-2:].upper()
        return _valid_utf16(content, order), F.decode(content, f"UTF-16{order}")
    if name == "utf-16":  # little-endian without a byte-order mark
        mark, body = F.hex(F.substring(content, 1, 2)), F.substring(content, 3, 2**31 - 1)
        valid = F.when(mark == "FFFE", _valid_utf16(body, "LE")).when(mark == "FEFF", _valid_utf16(body, "BE")).otherwise(_valid_utf16(content, "LE"))
        text = F.when(mark == "FFFE", F.decode(body, "UTF-16LE")).when(mark == "FEFF", F.decode(body, "UTF-16BE")).otherwise(F.decode(content, "UTF-16LE"))
        return valid, text
    if name == "ascii":
        return ~F.hex(content).rlike("^(?:..)*?[89A-F]"), F.decode(content, "US-ASCII")
    if name == "iso-8859-1":
        return F.lit(True), F.decode(content, "ISO-8859-1")
    if name == "cp1252":
        other = {chr(b): c for b, c in _CP1252.items() if c}
        return ~F.hex(content).rlike(_CP1252_HOLES), F.translate(F.decode(content, "ISO-8859-1"), "".join(other), "".join(other.values()))
    raise ValueError(f"unknown encoding {name}")


def decoded(content: Column, codecs: tuple[str, ...] = CODECS) -> Column:
    """``struct<codec, text>`` by the first of ``codecs`` in which ``content`` is valid; null if it is in none.

    Line ends of the text are ``\\n``.
    """
    found = None
    for name in codecs:
        valid, text = _codec(content, name)
        one = F.struct(F.lit(name).alias("codec"), F.regexp_replace(text, r"\r\n?", "\n").alias("text"))
        found = F.when(valid, one) if found is None else found.when(valid, one)
    return found


def decode_content(content: Column, codecs: tuple[str, ...] = CODECS) -> Column:
    """Bytes of a text file as a string."""
    return decoded(content, codecs)["text"]


def read_text_files(spark: SparkSession, path: str, codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """Text files below ``path`` as ``(path, length, page, codec, text)``; a file is one page, of null text if no codec fits."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    return files.select("path", "length", F.lit(1).alias("page"), decoded(F.col("content"), codecs).alias("d")).select("path", "length", "page", "d.*")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` as ``(path, name, length, route, reject_reason)``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length")
    return listed.select("*", route(F.col("path")).alias("route"), reject_reason(F.col("name"), F.col("length")).alias("reject_reason"))


def admitted_files(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """``(path, name, length, content)`` of the files of one route (``text`` or ``page``).

    The rules hold on the path and the length that the listing gives: a file that is refused or goes the other way is listed
    and never opened, whatever its size.  Page files must be admitted; text files have no such rule.
    """
    name = F.regexp_extract("path", "[^/]*$", 0)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if wanted == "text":
        files = files.option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    else:
        files = files.option("pathGlobFilter", "*.[pP][dD][fF]").load(path).where(F.col("length") <= MAX_UPLOAD_BYTES)
    return files.select("path", name.alias("name"), "length", "content")


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.[^./]+$", 0)


def route(path: Column) -> Column:
    """``text`` for ``.txt`` in any case, ``page`` for everything else."""
    return F.when(suffix(path) == ".txt", "text").otherwise("page")


def reject_reason(name: Column, size: Column) -> Column:
    """First admission rule a file fails; null when it is admitted."""
    return (
        F.when(name.isNull(), "no_file")
        .when(name == "", "empty_name")
        .when(~F.lower(name).endswith(".pdf"), "not_pdf")
        .when(size > MAX_UPLOAD_BYTES, "too_large")
    )
