"""Running sums within an array, in time that grows with its length alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed up anew for each place; blocks of so many are summed once.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once; an expression within a lambda would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column) -> Column:
    """For each element, the sum of those before it.

    Spark has no running sum over an array, and a fold that appends copies what it has for each element.  Sums of whole
    blocks come first, so an element adds up at most ``BLOCK`` others.
    """
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def running(v: Column) -> Column:
        blocks = F.ceil(F.size(v) / BLOCK).cast("int")
        numbers = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
        parts = F.transform(numbers, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return let(parts, lambda p: let(F.transform(p, total), lambda sums: F.flatten(F.transform(p, lambda part, k: let(total(F.slice(sums, F.lit(1), k)), lambda base: F.transform(part, lambda _x, i: base + total(F.slice(part, F.lit(1), i))))))))

    return let(values, running)
