"""Replacing many values in a text, in time that grows with the text.

:func:`replace_in_order` gives the text in which every occurrence of each value, value after value, became its mask.  Done
literally that costs the number of values times the length of the text.  Here all values form one regular expression, factored
by common beginnings like a trie.  It finds in one pass where values stand; values none of whose occurrences touches one of
another commute with all the rest and are replaced in one more pass.  Only values that do get into each other's way are
replaced one by one, in order.  All of it is native expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.binding import bind
from inkveil.functions.pyregex import to_java

#: Up to so many values are replaced one by one, which costs less than to look for conflicts; the text is the same.
FEW = 8
#: Characters by which the expression branches; behind them the values of a branch are listed.
DEPTH = 12
BLOCK = 256
#: Up to so many folded values are alternatives of an expression, one beside the other, which is sooner written than a trie.
LISTED = 32
#: Signs before a value and behind it, where the values of a text are written into it; a text that holds one is split instead.
OPEN, CLOSE = "\x02", "\x03"
STRINGS = "array<string>"


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states of a fold after each item.  In blocks, for appending to one growing array copies it each time."""
    def one(acc: Column, x: Column) -> Column:
        return bind(step(acc["state"], x), lambda s: F.struct(s.alias("state"), F.concat(acc["out"], F.array(s)).alias("out")))

    def block(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)
        return bind(inner, lambda b: F.struct(b["state"].alias("state"), F.concat(acc["blocks"], F.array(b["out"])).alias("blocks")))

    def in_blocks(some: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(some), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda s: F.slice(some, s, F.lit(BLOCK)))
        empty = F.struct(zero.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("blocks"))
        return F.flatten(F.aggregate(blocks, empty, block)["blocks"])

    return bind(items, in_blocks)


def quoted(value: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


#: A line break with blanks around it and a hyphen before it, and the same for texts without tabs and carriage returns.
_BREAK = r"(?:-?\p{Blank}*\r?\n\p{Blank}*)?"
_SHORT_BREAK = r"(?:-?\x20*\n\x20*)?"
_BLANKS = to_java(r"\s+")
#: Stands for a possible break while an expression is written.
_GAP = "\x01"


def folded(value: Column) -> Column:
    """Lower case, each run of blanks as one."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(value, "\u0130", "i")), _BLANKS, " "))


def squeezed(value: Column) -> Column:
    """A text without what :func:`one_of` overlooks in its broken form: a text that holds a value holds it squeezed."""
    return F.regexp_replace(F.upper(F.lower(F.regexp_replace(value, "\u0130", "i"))), to_java(r"[\s-]+"), "")


def _breakable(value: Column, behind: str) -> Column:
    """Each character of ``value`` after a possible line break; a blank as any blanks."""
    broken = _BREAK.replace("\\", "\\\\")
    each = F.regexp_replace(value, F.lit("(?s)."), F.lit(broken + r"\\Q$0\\E" + behind))
    return F.replace(each, F.lit(r"\Q \E"), F.lit(_BLANKS))


def one_of_folded(text: Column, values: Column) -> Column:
    """:func:`one_of` ``values`` in its broken form, for one text: short if the values are few, as the expression is written and
    compiled for each text."""
    def listed(some: Column) -> Column:  # values with a line end between them, as no folded value holds one
        def broken(gap: str) -> Column:
            gaps = F.regexp_replace(some, F.lit(r"(?s)([^\n])(?!\n|\z)"), F.lit("$1" + _GAP)) if gap else some
            safe = F.regexp_replace(gaps, F.lit(r"[\\^$.|?*+()\[\]{}]"), F.lit(r"\\$0"))
            ways = F.replace(F.replace(safe, F.lit("\n"), F.lit("|")), F.lit(" "), F.lit(_BLANKS))
            return F.regexp_replace(ways, F.lit(_GAP), F.lit(gap.replace("\\", "\\\\"))) if gap else ways

        expression = F.when(text.rlike(r"[\t\r]"), broken(_BREAK)).when(text.contains("\n"), broken(_SHORT_BREAK)).otherwise(broken(""))
        return F.concat(F.lit("(?iu)(?:"), expression, F.lit(")"))

    few = (F.size(values) <= LISTED) & ~F.exists(values, lambda v: v.contains(_GAP))
    return F.when(few, bind(F.array_join(F.reverse(F.array_sort(values)), "\n"), listed)).otherwise(one_of(values, broken=True))


def one_of(values: Column, broken: bool = False) -> Column:
    """Regular expression for any of ``values`` (distinct, not empty, at least one), the longest that stands at a place.

    In descending order each value shares its beginning with the one before it or closes the branches of that one, and stands
    behind all values that it begins.  ``broken``: the values are :func:`folded`; case does not count, any blanks stand for a
    blank, and a line break may stand between two characters.
    """
    depth = lambda v: F.least(F.length(v), F.lit(DEPTH))
    places = F.array(*[F.lit(i) for i in range(1, DEPTH + 1)])

    def branch(before: Column, value: Column) -> Column:
        shared = F.size(F.filter(places, lambda n: (n <= depth(before)) & (n <= depth(value)) & (F.left(before, n) == F.left(value, n))))

        def written(c: Column) -> Column:
            up = F.when(before == "", F.lit("")).otherwise(F.concat(F.repeat(F.lit(")"), depth(before) - c), F.lit("|")))
            head, tail = F.substring(value, c + 1, depth(value) - c), F.substring(value, F.lit(DEPTH + 1), F.length(value))
            if not broken:
                down = F.regexp_replace(head, F.lit("(?s)."), F.lit(r"\\Q$0\\E(?:"))
                rest = quoted(tail)
            else:
                down = _breakable(head, "(?:")
                down = F.when(c == 0, F.substring(down, F.lit(len(_BREAK) + 1), F.length(down))).otherwise(down)
                rest = _breakable(tail, "")
            return F.concat(up, down, F.when(F.length(value) > DEPTH, rest).otherwise(F.lit("")))

        return bind(shared, written)

    def joined(falling: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(falling, F.lit(1), F.size(falling) - 1))
        start = F.lit("(?iu)(?:" if broken else "(?:")
        return F.concat(start, F.array_join(F.zip_with(before, falling, branch), ""), F.repeat(F.lit(")"), depth(F.element_at(falling, -1))), F.lit(")"))

    return bind(F.reverse(F.array_sort(values)), joined)


def _occurrences(text: Column, regex: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(first, found, after)`` of the places where a value begins.

    ``first`` is the text before the first of them, ``found`` the longest value at each, ``after`` what follows each beginning
    up to the next one.
    """
    ahead = F.concat(F.lit("(?=("), regex, F.lit("))"))

    def by_gap(found: Column) -> Column:
        def measured(gaps: Column) -> Column:  # no empty gap stands before a value at the start
            leads = F.size(gaps) > F.size(found)
            after = F.when(leads, F.slice(gaps, F.lit(2), F.size(found))).otherwise(gaps)
            return bind(after, lambda some: use(F.when(leads, F.element_at(gaps, 1)).otherwise(F.lit("")), found, some))

        return bind(F.split(text, ahead, -1), measured)

    def written(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.size(parts))
        each = F.transform(rest, lambda p: F.substring_index(p, CLOSE, 1))
        return bind(each, lambda found: bind(
            F.zip_with(found, rest, lambda v, p: F.substring(p, F.length(v) + 2, F.length(p))), lambda after: use(F.element_at(parts, 1), found, after)))

    # Written into the text the values cost one compilation of the expression and one search.
    marked = F.regexp_replace(text, ahead, F.lit(f"{OPEN}$1{CLOSE}"))
    return F.when(text.rlike(f"[{OPEN}{CLOSE}]"), bind(F.regexp_extract_all(text, ahead, F.lit(1)), by_gap)).otherwise(
        bind(F.split(marked, OPEN, -1), written))


def _touches(found: Column, after: Column) -> Column:
    return F.exists(F.zip_with(found, after, lambda v, g: F.length(g) < F.length(v)), lambda t: t)


def _reaches(found: Column, after: Column) -> Column:
    """How far values go: ``covered`` characters of each gap, ``over`` into the next one, ``hit`` if the value touches another."""
    steps = F.zip_with(found, after, lambda v, g: F.struct(F.length(v).alias("needs"), F.length(g).alias("has")))
    zero = F.struct(F.lit(0).alias("over"), F.lit(False).alias("hit"), F.lit(0).alias("covered"))

    def step(s: Column, x: Column) -> Column:
        needs = F.greatest(x["needs"], s["over"])
        return F.struct(F.greatest(needs - x["has"], F.lit(0)).alias("over"), ((s["over"] > 0) | (x["has"] < x["needs"])).alias("hit"),
                        F.least(needs, x["has"]).alias("covered"))

    return running(steps, zero, step, "struct<over:int,hit:boolean,covered:int>")


def entangled(text: Column, values: Column, regex: Column) -> Column:
    """Those of ``values`` with an occurrence in ``text`` that touches an occurrence of another value or of its own.

    ``regex`` is :func:`one_of` them.  A place where values begin shows the longest; shorter ones there begin it, and a value
    that begins another is entangled wherever it stands.
    """
    def touching(first: Column, found: Column, after: Column) -> Column:
        hit = F.array_compact(F.zip_with(found, _reaches(found, after), lambda v, r: F.when(r["hit"], v)))
        return F.when(_touches(found, after), hit).otherwise(F.array().cast(STRINGS))

    def beginning(rising: Column) -> Column:
        first = running(rising, F.lit(""), lambda s, x: F.when((s != "") & F.startswith(x, s), s).otherwise(x), "string")
        return F.flatten(F.zip_with(rising, first, lambda x, f: F.when(x != f, F.array(x, f)).otherwise(F.array().cast(STRINGS))))

    return F.array_distinct(F.concat(_occurrences(text, regex, touching), bind(F.array_sort(values), beginning)))


def cover(text: Column, regex: Column, char: str) -> Column:
    """``text`` with every character of every occurrence, touching ones too, as ``char``; line ends stay."""
    def piece(gap: Column, n: Column) -> Column:
        return F.concat(F.regexp_replace(F.left(gap, n), F.lit(r"[^\r\n]"), F.lit(char)), F.substring(gap, n + 1, F.length(gap)))

    def masked(first: Column, found: Column, after: Column) -> Column:
        apart = F.zip_with(found, after, lambda v, g: piece(g, F.length(v)))
        pieces = F.when(_touches(found, after), F.zip_with(after, _reaches(found, after), lambda g, r: piece(g, r["covered"]))).otherwise(apart)
        return F.concat(first, F.array_join(pieces, ""))

    return _occurrences(text, regex, masked)


def replace_in_order(text: Column, values: Column, mask: Callable[[Column], Column], one_by_one: Column | None = None) -> Column:
    """``text`` after ``replace(text, v, mask(v))`` for each of ``values`` (distinct, not empty) in order.

    Masks must not make new occurrences of values; where ``one_by_one`` holds that is not asked.
    """
    def in_turn(start: Column, some: Column) -> Column:
        return F.aggregate(some, start, lambda acc, v: F.replace(acc, v, mask(v)))

    def at_once(start: Column, some: Column, regex: Column) -> Column:
        found = F.regexp_extract_all(start, regex, F.lit(0))
        pieces = F.zip_with(F.split(start, regex, -1), found, lambda gap, v: F.concat(gap, F.when(v.isNull(), F.lit("")).otherwise(mask(v))))
        return F.when(F.size(some) == 0, start).otherwise(F.array_join(pieces, ""))

    def by_conflict(regex: Column) -> Column:
        def both(knot: Column) -> Column:
            free = F.array_except(values, knot)
            done = bind(F.when(F.size(knot) == 0, regex).when(F.size(free) == 0, F.lit("")).otherwise(one_of(free)), lambda r: at_once(text, free, r))
            return in_turn(done, F.array_intersect(values, knot))

        return bind(entangled(text, values, regex), both)

    few = F.size(values) <= FEW
    if one_by_one is not None:
        few = few | one_by_one
    return F.when(few, in_turn(text, values)).otherwise(bind(one_of(values), by_conflict))
