"""Checksums and format checks as native column expressions.

They use higher-order functions, so apply them to extracted values, never to
whole texts.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.binding import bind
from inkveil.functions.matching import is_plain, rlike
from inkveil.functions.patterns import calling_code_regex
from inkveil.functions.pyregex import to_java

# Verhoeff multiplication (10x10) and permutation (8x10) tables,
# row after row, and the holder letters allowed at position four of a PAN.
VERHOEFF_MULT = (
    "0123456789" "1234067895" "2340178956" "3401289567" "4012395678"
    "5987604321" "6598710432" "7659821043" "8765932104" "9876543210"
)
VERHOEFF_PERM = (
    "0123456789" "1576283094" "5803796142" "8916043527"
    "9453126870" "4286573901" "2793806415" "7046913258"
)
PAN_HOLDER = "ABCFGHLJPT"


#: Every decimal digit of Unicode, and its value.
_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def ascii_digits(value: Column) -> Column:
    """Decimal digits of all scripts as 0-9."""
    return F.when(is_plain(value), value).otherwise(F.translate(value, _DIGITS, _DIGIT_VALUES))


def strip_separators(value: Column) -> Column:
    """Remove hyphens and blanks."""
    return F.regexp_replace(value, to_java(r"[-\s]"), "")


def strip_blanks(value: Column) -> Column:
    return F.regexp_replace(value, to_java(r"\s+"), "")


def normalise_value(category: Column, value: Column) -> Column:
    """Form in which a value is checked: separators out, letters upper for bank and tax codes."""
    return (
        F.when(category.isin("iban", "bic"), F.upper(strip_blanks(value)))
        .when(category == "pan", F.upper(strip_separators(value)))
        .otherwise(strip_separators(value))
    )


def luhn_valid(value: Column) -> Column:
    return F.call_function("luhn_check", ascii_digits(strip_separators(value)))


def verhoeff_valid(value: Column) -> Column:
    """Twelve digits whose Verhoeff check digit is right."""
    # One table for each place of eight: the remainder after a digit, by the remainder before it and the digit.
    tables = [F.array(*[F.lit(int(VERHOEFF_MULT[rest * 10 + int(VERHOEFF_PERM[place * 10 + digit])])) for rest in range(10) for digit in range(10)])
              for place in range(8)]

    def check(digits: Column) -> Column:
        rest = F.lit(0)
        for i in range(12):
            rest = F.get(tables[i % 8], rest * 10 + F.ascii(F.substring(digits, 12 - i, 1)) - 48)
        return rest

    def decide(digits: Column) -> Column:
        return F.coalesce(F.when(digits.rlike("^[0-9]{12}$"), check(digits) == 0), F.lit(False))

    return bind(strip_separators(value), lambda code: bind(ascii_digits(code), decide))


def iban_valid(value: Column) -> Column:
    """Format, then modulo 97 with a rolling remainder (no big integers)."""
    def rest(rotated: Column) -> Column:
        def step(acc, i):
            return bind(F.ascii(F.substring(rotated, i, F.lit(1))), lambda point: F.when(
                point < 58, (acc * 10 + point - 48) % 97).otherwise((acc * 100 + point - 55) % 97))

        return F.aggregate(F.sequence(F.lit(1), F.length(rotated)), F.lit(0), step)

    def decide(code: Column) -> Column:
        rotated = bind(ascii_digits(code), lambda plain: F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)))
        return F.coalesce(F.when(rlike(code, r"^[A-Z]{2}\d{2}[A-Z0-9]{4,}$"), bind(rotated, rest) == 1), F.lit(False))

    return bind(F.upper(strip_blanks(value)), decide)


def bic_valid(value: Column) -> Column:
    return F.upper(strip_blanks(value)).rlike("^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$")


def pan_valid(value: Column) -> Column:
    return rlike(F.upper(strip_separators(value)), rf"^[A-Z]{{3}}[{PAN_HOLDER}][A-Z]\d{{4}}[A-Z]$")


def calling_code_valid(value: Column) -> Column:
    """International number whose digits start with an assigned country code."""
    return F.regexp_replace(value, "[^0-9]", "").rlike(calling_code_regex())


VALIDATORS = {
    "luhn": luhn_valid,
    "aadhaar": verhoeff_valid,
    "iban": iban_valid,
    "bic": bic_valid,
    "pan": pan_valid,
    "calling_code": calling_code_valid,
}


def escape_literal(text: Column) -> Column:
    """Regex for the literal ``text`` as a whole word."""
    return F.concat(F.lit(r"\b\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))


def mask_chars(value: Column, char: str = "*") -> Column:
    return F.repeat(F.lit(char), F.length(value))
