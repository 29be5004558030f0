"""Tokens of lines: all of them, their counts, and those at given places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linescope.functions import cells


def tokens(lines: DataFrame, mode: str = "wide") -> DataFrame:
    """A row for each token of each line: ``start``, ``end`` (exclusive), ``token``."""
    rows = lines.withColumn("_t", F.explode(cells.tokens(F.col("text"), mode)))
    return rows.withColumns({"start": F.col("_t.start"), "end": F.col("_t.start") + F.col("_t.len"), "token": F.col("_t.matched")}).drop("_t")


def token_counts(lines: DataFrame, mode: str = "wide") -> DataFrame:
    """How often each token occurs."""
    pattern = F.lit(cells.TOKENS[mode].java())
    return lines.select(F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def token_at(lines: DataFrame, probes: DataFrame, mode: str = "wide") -> DataFrame:
    """Each (path, line_no, index) with ``start``, ``end`` and ``token`` of the token over that character.

    They are null on white space, outside the line, and where there is no such line.
    """
    found = probes.join(lines.select("path", "line_no", "text"), ["path", "line_no"], "left")
    found = found.withColumn("_t", cells.token_over(F.col("text"), F.col("index"), mode))
    place = F.col("_t.start").alias("start"), (F.col("_t.start") + F.length("_t.token")).alias("end")
    return found.select(*probes.columns, *place, F.col("_t.token").alias("token"))
