"""Local names inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(fn: Callable[..., Column], **values: Column) -> Column:
    """Evaluate ``values`` once per row and build ``fn`` from the results.

    The optimizer may copy a column's definition to where it is used. Inside an
    array lambda that would repeat the work for every element; a bound name does not.
    """
    bound = F.transform(
        F.array(F.struct(*[v.alias(k) for k, v in values.items()])),
        lambda s: fn(**{k: s[k] for k in values}),
    )
    return F.get(bound, F.lit(0))


def once(col: Column) -> Column:
    """The same values, computed in one place of the plan.

    Exploding an array makes Spark filter on its size first and push that filter
    down, which repeats the array's whole definition. A definition that depends on
    where it runs is left in place; the partition number is never negative, so the
    values stay the same.
    """
    return F.when(F.spark_partition_id() >= 0, col)
