"""Searches for one pattern or many, and walks from hit to hit. A hit is a line, not an occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linescope.functions.many import matching
from linescope.functions.patterns import Pattern, matches, segments, spans
from linescope.plans.ordered import BYTES, carried_last, running_sum
from linescope.sources.lines import number_lines, with_all

MAX_HITS = 1_000_000


def search(lines: DataFrame, pattern: Pattern, limit: int | None = None) -> DataFrame:
    """The lines that match. No order is imposed; (path, byte_off) orders hits.

    ``limit=MATCH_LIMIT`` is the reference's search: patterns other than plain text see the first 64 KiB of a line.
    """
    return lines.where(matches(F.col("text"), pattern.check(), limit))


def search_files(raw_lines: DataFrame, pattern: Pattern, boms: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The lines of ``read_lines`` that match, with their numbers and offsets; the text of other lines is not carried."""
    hit = matches(F.col("text"), pattern.check(), limit)
    marked = raw_lines.withColumn("text", F.when(hit, F.col("text")))
    return number_lines(marked, boms).where(F.col("text").isNotNull())


def ordinals(hits: DataFrame, width: int | None = BYTES) -> DataFrame:
    """``hit_no`` from 1 within a file."""
    return running_sum(hits, F.lit(1).cast("long"), "byte_off", "hit_no", width=width)


def cap_hits(hits: DataFrame, max_hits: int = MAX_HITS, width: int | None = BYTES) -> DataFrame:
    """The first ``max_hits`` hits of each file."""
    return ordinals(hits, width).where(F.col("hit_no") <= max_hits)


def search_summary(lines: DataFrame, pattern: Pattern, max_hits: int = MAX_HITS, files: DataFrame | None = None) -> DataFrame:
    """Per file, also without hits: ``total_hits`` up to the cap, ``truncated`` once it is reached, hits per line.

    With ``files`` (path), files without lines have a row too: no hits, and a ratio of null.
    """
    hit = matches(F.col("text"), pattern.check(), None).cast("long")
    found = lines.groupBy("path").agg(F.sum(hit).alias("n"), F.count("*").alias("lines"))
    found = found if files is None else with_all(found, files, ["path"], ("n", "lines"))
    total, truncated = F.least("n", F.lit(max_hits)).alias("total_hits"), (F.col("n") >= max_hits).alias("truncated")
    return found.select("path", total, truncated, F.try_divide("n", "lines").alias("hit_ratio"))


def search_many(lines: DataFrame, filters: dict[str, Pattern]) -> DataFrame:
    """All named filters in one scan: a row for each line and filter that matches it.

    More than a few filters are looked for together (``functions.many``), hundreds at little more than the cost of one.
    """
    found = matching(F.col("text"), [p.check() for p in filters.values()])
    names = F.array(*[F.lit(n) for n in filters])
    return lines.withColumn("filter_name", F.explode(F.transform(found, lambda i: F.get(names, i))))


def match_spans(lines: DataFrame, pattern: Pattern) -> DataFrame:
    """A row for every non-empty occurrence: ``start``, ``len``, ``matched``."""
    found = lines.where(matches(F.col("text"), pattern.check(), None))
    return found.withColumn("span", F.explode(spans(F.col("text"), pattern))).select("*", "span.*").drop("span")


def match_segments(lines: DataFrame, pattern: Pattern) -> DataFrame:
    """Matching lines cut into pieces ``(seg_no, segment, is_match)``."""
    found = lines.where(matches(F.col("text"), pattern.check(), None))
    found = found.select("*", F.posexplode(segments(F.col("text"), pattern)).alias("seg_no", "piece"))
    return found.select("*", "piece.*").drop("piece")


def _walk(marks: DataFrame, probes: DataFrame, forward: bool, width: int | None) -> DataFrame:
    values = marks.select("path", F.col("byte_off").alias("at"), F.col("byte_off").alias("mark"), F.lit(None).cast("long").alias("probe"))
    asked = probes.select("path", F.col("offset").alias("at"), F.lit(None).cast("long").alias("mark"), F.col("offset").alias("probe"))
    # on the way to the next mark rows are read backwards; either way a mark at the probe's own offset comes after it
    both = values.unionByName(asked).withColumn("kind", F.when(F.col("probe").isNull() == F.lit(forward), 0).otherwise(1))
    return carried_last(both, "mark", "at", "found", ties=("kind",), width=width, forward=not forward).where("probe is not null")


def next_mark(marks: DataFrame, probes: DataFrame, width: int | None = BYTES) -> DataFrame:
    """``(path, offset, next_off)``: the first mark or hit strictly after each probe, null if there is none."""
    return _walk(marks, probes, True, width).select("path", F.col("probe").alias("offset"), F.col("found").alias("next_off"))


def prev_mark(marks: DataFrame, probes: DataFrame, width: int | None = BYTES) -> DataFrame:
    """``(path, offset, prev_off)``: the last mark or hit strictly before each probe, null if there is none."""
    return _walk(marks, probes, False, width).select("path", F.col("probe").alias("offset"), F.col("found").alias("prev_off"))


def hit_rank(hits: DataFrame, probes: DataFrame, width: int | None = BYTES) -> DataFrame:
    """``(path, offset, hit_index)``: the index from 0 of the first hit at or after each probe, or the last hit's."""
    values = hits.select("path", F.col("byte_off").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("probe"))
    asked = probes.select("path", F.col("offset").alias("at"), F.lit(0).alias("kind"), F.col("offset").alias("probe"))
    ranked = running_sum(values.unionByName(asked), F.col("kind").cast("long"), "at", "before", ties=("kind",), width=width)
    totals = hits.groupBy("path").agg(F.count("*").alias("n"))
    found = ranked.where("kind = 0").join(totals, "path")
    return found.select("path", F.col("probe").alias("offset"), F.least(F.col("before"), F.col("n") - 1).alias("hit_index"))
