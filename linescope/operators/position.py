"""Positional access: lookups by line number or offset, pages, windows and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescope.functions.patterns import head
from linescope.plans.ordered import BYTES, LINES, carried_last

ELLIPSIS = "…"


def get_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (path, line_no) with their text and offset; those out of range are left to ``missing_lines``."""
    return wanted.join(lines, ["path", "line_no"])


def missing_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(lines.select("path", "line_no"), ["path", "line_no"], "left_anti")


def line_to_offset(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(lines.select("path", "line_no", "byte_off"), ["path", "line_no"])


def offset_to_line(lines: DataFrame, probes: DataFrame, width: int | None = BYTES) -> DataFrame:
    """``(path, probe, line_no)``: the line that holds each offset, those outside being moved to the nearest line.

    An as-of join by one ordered pass over line starts and probes together.
    """
    starts = lines.select("path", F.col("byte_off").alias("at"), F.lit(0).alias("kind"), "line_no", F.lit(None).cast("long").alias("probe"))
    at, none = F.greatest(F.col("offset"), F.lit(0)).alias("at"), F.lit(None).cast("long").alias("line_no")
    asked = probes.select("path", at, F.lit(1).alias("kind"), none, F.col("offset").alias("probe"))
    found = carried_last(starts.unionByName(asked), "line_no", "at", "found", ties=("kind",), width=width)
    return found.where("kind = 1 and found is not null").select("path", "probe", F.col("found").alias("line_no"))


def page_at(lines: DataFrame, probes: DataFrame, rows: int, width: int | None = BYTES) -> DataFrame:
    """The first ``rows`` lines from the first line start at or after each (path, offset), counted by ``turn``.

    An as-of join finds that line; the page's lines are then looked up by their numbers.
    """
    none = F.lit(None).cast("long")
    starts = lines.select("path", F.col("byte_off").alias("at"), F.lit(1).alias("kind"), F.col("line_no").alias("first"), none.alias("offset"))
    asked = probes.select("path", F.greatest(F.col("offset"), F.lit(0)).alias("at"), F.lit(0).alias("kind"), none.alias("first"), F.col("offset").cast("long"))
    found = carried_last(starts.unionByName(asked), "first", "at", "found", ties=("kind",), width=width, forward=False)
    numbers = F.posexplode(F.sequence(F.col("found"), F.col("found") + rows - 1)).alias("turn", "line_no")
    pages = found.where("kind = 0 and found is not null").select("path", "offset", numbers)
    return pages.withColumn("turn", F.col("turn") + 1).join(lines, ["path", "line_no"])


def jump_percent(lines: DataFrame, files: DataFrame, share: Column, rows: int) -> DataFrame:
    """Pages at a share (0 to 1) of each file's size; at the end of a file its last line."""
    at = F.floor(F.col("size") * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    last = lines.groupBy("path").agg(F.max("byte_off").alias("last"))
    probes = files.select("path", at.alias("asked")).join(last, "path").select("path", F.least("asked", "last").alias("offset"))
    return page_at(lines, probes, rows)


def centered_window(lines: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """``rows`` lines around each (path, target), beginning ``rows`` / 2 before it, not before line 0."""
    first = F.greatest(F.col("target") - rows // 2, F.lit(0))
    spread = targets.select("path", "target", F.explode(F.sequence(first, first + rows - 1)).alias("line_no"))
    return spread.join(lines, ["path", "line_no"])


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines of each file."""
    turn = F.row_number().over(Window.partitionBy("path").orderBy(F.col("line_no").desc()))
    return lines.withColumn("turn", turn).where(F.col("turn") <= n).drop("turn")


def adjacent_lines(lines: DataFrame, width: int | None = LINES) -> DataFrame:
    """Each line of whole files with the start of the next one (the file's end after the last) and of the one before.

    The first line has its own start as the one before.
    """
    found = carried_last(lines, "byte_off", "line_no", "prev_off", width=width, strict=True)
    return found.withColumns({"next_off": F.col("byte_off") + F.col("n_bytes") + 1, "prev_off": F.coalesce("prev_off", "byte_off")})


def line_range(lines: DataFrame, ranges: DataFrame, copy_cap: int = 100_000, block: int = 4096) -> DataFrame:
    """Lines of the inclusive (path, top, bottom), with ``rows`` of the range and whether they pass the copy cap.

    Ranges meet the lines in blocks of ``block`` numbers, so only blocks that a range touches are looked at.
    """
    last = lines.groupBy("path").agg(F.max("line_no").alias("last"))
    cut = ranges.join(last, "path").withColumns({"from": F.greatest("top", F.lit(0)), "to": F.least("bottom", "last")}).where("from <= to")
    rows = (F.col("to") - F.col("from") + 1).alias("rows")
    touched = F.explode(F.sequence(F.floor(F.col("from") / block), F.floor(F.col("to") / block))).alias("_block")
    cut = cut.select("path", "top", "bottom", "from", "to", rows, touched)
    found = lines.withColumn("_block", F.floor(F.col("line_no") / block)).join(cut, ["path", "_block"])
    return found.where("line_no between from and to").drop("_block", "from", "to").withColumn("too_many", F.col("rows") > copy_cap)


def clamp_text(lines: DataFrame, max_bytes: int = 65_536, max_chars: int = 8_192) -> DataFrame:
    """Lines for display: text over either limit is cut and ends with an ellipsis."""
    seen = head(F.col("text"), max_bytes)
    clamped = (F.octet_length("text") > max_bytes) | (F.length("text") > max_chars)
    cut = F.concat(F.substring(seen, 1, max_chars), F.lit(ELLIPSIS))
    return lines.withColumns({"shown": F.when(clamped, cut).otherwise(F.col("text")), "is_clamped": clamped})


def sample_lines(lines: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """``n`` lines that a seed picks, the same in every run: those with the smallest md5 of path, number and seed."""
    place = F.md5(F.concat_ws(":", F.col("path").cast("string"), F.col("line_no").cast("string"), F.lit(str(seed))).cast("binary"))
    return lines.orderBy(place, "path", "line_no").limit(n)
