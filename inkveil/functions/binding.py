"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    A chain of ``withColumn`` steps that each refer to the former one several
    times multiplies when the optimizer pushes a filter through it.  A lambda
    variable keeps the expression linear in the number of steps.  The variable
    is the state of a fold over nothing: to take an item of an array instead,
    Spark works out the type of all that ``use`` holds again for each row.
    """
    return F.aggregate(F.array(), value, lambda same, _: same, use)
