"""Running values, ranks and as-of lookups inside an array column.

None of them grows an array step by step or compares all pairs: running values take
``log2(n)`` whole-array passes, lookups are binary searches. All stays in SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.binding import let


def _strides(size: Column) -> Column:
    """1, 2, 4, ... up to the last power of two below ``size`` (1 at least)."""
    last = F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.pow(F.lit(2.0), k).cast("int"))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Element ``i`` becomes ``combine`` of elements 0 to ``i`` (any associative function, such as a sum or a maximum)."""
    def doubled(held: Column, stride: Column) -> Column:
        return F.transform(held, lambda x, i: F.when(i >= stride, combine(F.get(held, i - stride), x)).otherwise(x))

    return let(lambda v: F.aggregate(_strides(F.size(v)), v, doubled), v=values)


def occurrences(values: Column) -> Column:
    """For each element of a string array: how many equal ones there are up to it, itself included."""
    def count(held: Column) -> Column:
        ordered = F.array_sort(F.transform(held, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        return let(number, ordered=ordered)

    def number(ordered: Column) -> Column:
        same = lambda x, i: (i > 0) & F.get(ordered, i - 1)["v"].eqNullSafe(x["v"])
        first = running(F.transform(ordered, lambda x, i: F.when(same(x, i), 0).otherwise(i)), F.greatest)
        return let(lambda begin: F.transform(
            F.array_sort(F.transform(ordered, lambda x, i: F.struct(x["i"].alias("i"), (i - F.get(begin, i) + 1).alias("nth")))),
            lambda x: x["nth"],
        ), begin=first)

    return let(count, held=values)


def last_at_or_before(marks: Column, pos: Column) -> Column:
    """Latest of ``marks`` (structs in increasing ``start``) whose start is not beyond ``pos``, else null."""
    def step(found: Column, stride: Column) -> Column:
        reach = found + stride
        return F.when((reach <= F.size(marks)) & (F.get(marks, reach - 1)["start"] <= pos), reach).otherwise(found)

    passed = F.aggregate(F.reverse(_strides(F.size(marks))), F.lit(0), step)
    return let(lambda n: F.when(n > 0, F.get(marks, n - 1)), n=passed)
