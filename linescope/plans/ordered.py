"""Windows along a file that also hold for one huge file.

A window by path alone would put a whole file into one task. With a ``width``, rows are ordered within ranges of that
many bytes (or lines), and what passes from range to range (a last value, a sum) is carried by a second, small window
over one row per range. Operators have a width of their own by default; without one (None) there is one range per path,
which suits many small files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes, or lines, of a range by default.
BYTES, LINES = 64 << 20, 1 << 20


def width_for(files: DataFrame, size: Column, width: int) -> int | None:
    """``width``, or None if no file is larger: ranges would only add an aggregate and a join to each window then.

    One small aggregate over ``files``, run at once. ``size`` is in the unit of ``width``, or one that is never smaller
    (a file has no more lines than bytes).
    """
    largest = files.agg(F.max(size)).first()[0]
    return width if largest is not None and largest > width else None


def _ranged(df: DataFrame, on: str, width: int | None) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(on) / width) if width else F.lit(0).cast("long"))


def carried_last(
    df: DataFrame,
    value: str,
    on: str,
    out: str,
    ties: tuple = (),
    by: tuple = ("path",),
    width: int | None = None,
    forward: bool = True,
    strict: bool = False,
) -> DataFrame:
    """``df`` with ``out``: the latest non-null ``value`` up to each row in order of ``on`` and ``ties``.

    ``forward=False`` looks at the rows behind instead; ``strict`` leaves the row itself out.
    """
    order = [F.col(on), *[F.col(t) for t in ties]]
    order = order if forward else [c.desc() for c in order]
    rows = _ranged(df, on, width)
    upto = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    rows = rows.withColumn(out, F.last(value, ignorenulls=True).over(upto))
    if not width:
        return rows.drop("_range")
    edge = F.max_by if forward else F.min_by
    place = F.when(F.col(value).isNotNull(), F.struct(on, *ties))
    ends = rows.groupBy(*by, "_range").agg(edge(F.col(value), place).alias("_end"))
    before = Window.partitionBy(*by).orderBy(F.col("_range") if forward else F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_range", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    joined = rows.join(ends, [*by, "_range"], "left")
    return joined.withColumn(out, F.coalesce(out, "_carry")).drop("_range", "_carry")


def running_sum(
    df: DataFrame, value: Column, on: str, out: str, ties: tuple = (), by: tuple = ("path",), width: int | None = None
) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows up to each one, itself included.

    ``by`` may be empty if there is a width: then rows of all paths are one sequence.
    """
    rows = _ranged(df, on, width).withColumn("_value", value)
    upto = Window.partitionBy(*by, "_range").orderBy(on, *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(out, F.sum("_value").over(upto))
    if not width:
        return rows.drop("_range", "_value")
    sums = rows.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    joined = rows.join(sums, [*by, "_range"])  # of as many rows as there are ranges
    return joined.withColumn(out, F.col(out) + F.col("_carry")).drop("_range", "_value", "_carry")
