"""Character spans of regex matches, computed natively.

``split`` gives the gaps between matches, so a running sum over gap and match
lengths yields every start and end.  The sum runs in blocks: appending to one
growing array would copy it once per match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.binding import bind

BLOCK = 1024
_SPANS = "array<struct<value:string,start:int,end:int>>"


def match_spans(text: Column, java_pattern: Column, matches: Column) -> Column:
    """``array<struct<value,start,end>>`` of ``matches`` of ``java_pattern`` in ``text``.

    ``start`` counts characters from 0, ``end`` is exclusive.  A single match whose value stands in the text
    once is there; to split the text Spark compiles the pattern again for each row.
    """
    def only(value: Column) -> Column:
        def by_place(at: Column) -> Column:
            once = (at > 0) & (F.call_function("locate", value, text, at + 1) == 0)
            item = F.struct(value.alias("value"), (at - 1).alias("start"), (at - 1 + F.length(value)).alias("end"))
            return F.when(once, F.array(item)).otherwise(_by_gaps(text, java_pattern, matches))

        return bind(F.call_function("locate", value, text), by_place)

    return F.when(F.size(matches) == 1, bind(F.get(matches, F.lit(0)), only)).otherwise(_by_gaps(text, java_pattern, matches))


def _by_gaps(text: Column, java_pattern: Column, matches: Column) -> Column:
    def in_block(acc, step):
        start = acc["pos"] + step["gap"]
        end = start + F.length(step["value"])
        item = F.struct(step["value"].alias("value"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("pos"), F.concat(acc["spans"], F.array(item)).alias("spans"))

    def next_block(acc, block):
        inner = F.aggregate(
            block, F.struct(acc["pos"].alias("pos"), F.array().cast(_SPANS).alias("spans")), in_block
        )
        return bind(
            inner,
            lambda b: F.struct(b["pos"].alias("pos"), F.concat(acc["blocks"], F.array(b["spans"])).alias("blocks")),
        )

    def from_gaps(gaps):
        # A zero-width match at the very start leaves no leading gap.
        lead = F.when(F.size(gaps) > F.size(matches), gaps).otherwise(F.concat(F.array(F.lit("")), gaps))
        steps = F.zip_with(
            F.slice(lead, F.lit(1), F.size(matches)),
            matches,
            lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")),
        )
        return bind(steps, in_blocks)

    def in_blocks(steps):
        starts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda s: F.slice(steps, s, F.lit(BLOCK)))
        zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPANS}>").alias("blocks"))
        return F.flatten(F.aggregate(blocks, zero, next_block)["blocks"])

    return bind(F.split(text, java_pattern, -1), from_gaps)


def context_window(text: Column, start: Column, end: Column, width: int) -> Column:
    """Text from ``width`` characters before the match to ``width`` behind it."""
    first = F.greatest(start - F.lit(width), F.lit(0))
    return F.substring(text, first + 1, end + F.lit(width) - first)
