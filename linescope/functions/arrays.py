"""Array expressions that others are built from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that are summed up in one pass; longer arrays are cut into groups.
GROUP = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it, as array<bigint>.

    An array grows by copying, so sums are taken within groups, each from the sum of the groups before it. A group has as
    many numbers as the cube root of all (``GROUP`` at least): copies within the groups and of the groups' sums then
    are as many, and grow with the array's length to the power of 4/3.
    """
    zero, empty = F.lit(0).cast("bigint"), F.expr("cast(array() as array<bigint>)")

    def within(part: Column, start: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(part, F.struct(start.alias("at"), empty.alias("out")), add, lambda acc: acc["out"])

    def grouped(all_: Column) -> Column:
        wide = F.greatest(F.ceil(F.cbrt(F.size(all_))).cast("int"), F.lit(GROUP))
        groups = let(wide, lambda w: F.transform(F.sequence(F.lit(1), F.size(all_), w), lambda at: F.slice(all_, at, w)))
        totals = lambda gs: F.transform(gs, lambda g: F.aggregate(g, zero, lambda s, x: s + x))
        return let(groups, lambda gs: F.flatten(F.zip_with(gs, within(totals(gs), zero), within)))

    return let(numbers.cast("array<bigint>"), lambda a: F.when(F.size(a) > GROUP, grouped(a)).otherwise(within(a, zero)))
