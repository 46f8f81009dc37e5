"""Python regular expressions on text columns.

Texts of ASCII characters take a short form of the expression, all others the full one; both give Python's matches, so the
choice is one of speed.  ``plain`` is the flag of a text, computed once where many expressions look at it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.pyregex import to_java


def is_plain(text: Column) -> Column:
    """Whether ``text`` holds ASCII characters only."""
    return F.octet_length(text) == F.length(text)


def _either(text: Column, plain: Column | None, regex: str, flags: int, use) -> Column:
    short, full = to_java(regex, flags, True), to_java(regex, flags)
    if short == full:
        return use(full)
    return F.when(is_plain(text) if plain is None else plain, use(short)).otherwise(use(full))


def rlike(text: Column, regex: str, flags: int = 0, plain: Column | None = None) -> Column:
    return _either(text, plain, regex, flags, text.rlike)


def matches(text: Column, regex: str, flags: int = 0, plain: Column | None = None) -> Column:
    """All matches, as ``re.finditer`` finds them."""
    return _either(text, plain, regex, flags, lambda java: F.regexp_extract_all(text, F.lit(java), F.lit(0)))


def extract(text: Column, regex: str, group: int, flags: int = 0, plain: Column | None = None) -> Column:
    """A group of the first match; the empty string without one."""
    return _either(text, plain, regex, flags, lambda java: F.regexp_extract(text, java, group))
