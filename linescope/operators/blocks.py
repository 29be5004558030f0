"""Context around hits: merged blocks, and the rows that show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linescope.plans.ordered import LINES, carried_last, running_sum


def block_hits(hits: DataFrame, files: DataFrame, n: int, width: int | None = LINES) -> DataFrame:
    """``(path, block_id, line_no, start, end)``: each hit with its block and the range of ``n`` lines around it.

    Repeated hits count once, ranges stay inside the file, and files without lines have none. Since ranges end later
    the later their hit is, a block begins where a range starts after the end of the one before it, plus one.
    """
    if n < 0:
        raise ValueError("context must not be negative")
    rows = hits.select("path", "line_no").join(files.select("path", "total_lines"), "path").where("total_lines > 0")
    last = F.col("total_lines") - 1
    hit = F.least(F.greatest(F.col("line_no"), F.lit(0)), last)
    rows = rows.select("path", hit.alias("line_no"), F.greatest(hit - n, F.lit(0)).alias("start"), F.least(hit + n, last).alias("end")).distinct()
    rows = carried_last(rows, "end", "line_no", "before", width=width, strict=True)
    opens = (F.col("before").isNull() | (F.col("start") > F.col("before") + 1)).cast("long")
    rows = running_sum(rows, opens, "line_no", "block_id", width=width)
    return rows.select("path", (F.col("block_id") - 1).alias("block_id"), "line_no", "start", "end")


def context_blocks(hits: DataFrame, files: DataFrame, n: int, width: int | None = LINES, hit_list: bool = False) -> DataFrame:
    """``blocks``: ranges of ``n`` lines around hits, merged where they overlap or touch.

    ``hit_list`` adds ``hit_lines``, the hits of each block as an array. A block of a large file may have very many:
    ``block_hits`` has them as rows.
    """
    lists = [F.sort_array(F.collect_list("line_no")).alias("hit_lines")] if hit_list else []
    return block_hits(hits, files, n, width).groupBy("path", "block_id").agg(
        F.min("start").alias("start_line"),
        F.max("end").alias("end_line"),
        (F.max("end") - F.min("start") + 1).alias("line_count"),
        F.count("*").alias("n_hits"),
        *lists,
    )


def block_rows(blocks: DataFrame, lines: DataFrame, hits: DataFrame, width: int | None = LINES) -> DataFrame:
    """``result_rows`` of the blocks of ``hits``: their lines, hits counted from 1, and a separator between blocks."""
    upto = running_sum(blocks.select("path", "block_id", "start_line", "end_line", "line_count"), F.col("line_count") + 1, "start_line", "upto", width=width)
    placed = upto.withColumn("row0", F.col("upto") - F.col("line_count") - 1)
    numbered = running_sum(hits.select("path", "line_no").distinct(), F.lit(1).cast("long"), "line_no", "hit_no", width=width)
    spread = placed.select("path", "row0", "start_line", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    shown = spread.join(lines.select("path", "line_no", "text"), ["path", "line_no"]).join(numbered, ["path", "line_no"], "left")
    shown = shown.select(
        "path",
        (F.col("row0") + F.col("line_no") - F.col("start_line")).alias("row_no"),
        F.when(F.col("hit_no").isNotNull(), "hit").otherwise("context").alias("kind"),
        "line_no",
        "hit_no",
        "text",
    )
    none = F.lit(None)
    gaps = placed.where("block_id > 0").select(
        "path",
        (F.col("row0") - 1).alias("row_no"),
        F.lit("separator").alias("kind"),
        none.cast("long").alias("line_no"),
        none.cast("long").alias("hit_no"),
        none.cast("string").alias("text"),
    )
    return shown.unionByName(gaps)


def hit_rows(hits: DataFrame, width: int | None = LINES) -> DataFrame:
    """``result_rows`` without context: a row for each hit and no separators."""
    numbered = running_sum(hits, F.lit(1).cast("long"), "line_no", "hit_no", width=width)
    return numbered.select("path", (F.col("hit_no") - 1).alias("row_no"), F.lit("hit").alias("kind"), "line_no", "hit_no", "text")


def select_rows(result_rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen (path, row_no) of result rows; (path, row_no) orders them."""
    return result_rows.join(chosen, ["path", "row_no"], "left_semi")
