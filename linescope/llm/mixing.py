"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a target number of words, its share by weight, at most ``most`` times its size. Its documents are
put in a fixed pseudo-random order and taken from the start, again from the start in further rounds, until the target is
reached; the last copy is cut there. A source's weight over training time t in [0, 1] follows a piecewise linear
schedule; its integral gives the words that the source has delivered by t, and inverting that gives each copy the
position at which its first word is due. Copies are then sorted by range of position.

The order within a source is that of the md5 of the key, so its words before a document are a sum over smaller buckets
(by the first hex digits of the md5) plus a running sum within one bucket: two grouped sums and a window over a small
bucket, however large a source is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescope.llm.common import Scratch, partitions, word_count

Knots = tuple[tuple[float, float], ...]

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Schedules in the same order: early sources fade, some stay, others come late. Each is (time, factor) knots from 0 to 1.
SCHEDULES: tuple[Knots, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Hex digits of the md5 that make a bucket (16 ** 3 buckets a source).
BUCKET_DIGITS = 3
#: A word and the blanks behind it.
WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def position(share: Column, knots: Knots) -> Column:
    """The time by which ``share`` of a source's words is due: the inverse of the integral of its schedule."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, done, out = sum(area), 0.0, None
    if whole <= 0 or min(w for _, w in knots) < 0 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule runs from time 0 to 1 with weights of 0 or more, not all 0")
    want = share * F.lit(whole)
    for (a, b), size in zip(zip(knots, knots[1:]), area):
        if size > 0:
            x, w, slope = want - F.lit(done), F.lit(float(a[1])), (b[1] - a[1]) / (b[0] - a[0])
            here = F.lit(float(a[0])) + F.lit(2.0) * x / (w + F.sqrt(w * w + F.lit(2.0 * slope) * x))
            here = F.when(x <= 0, F.lit(float(a[0]))).otherwise(here)
            out = F.when(want < F.lit(done + size), here) if out is None else out.when(want < F.lit(done + size), here)
            done += size
    return out.otherwise(F.lit(1.0))


def _ranked(scratch: Scratch, names: DataFrame, column: str) -> DataFrame:
    """``names`` with ``rank`` from 0 by ``column``: a rank in each range, plus the rows of smaller ranges."""
    ordered = names.repartitionByRange(partitions(scratch.spark), column)
    at = ordered.sortWithinPartitions(column).withColumn("at", F.monotonically_increasing_id())
    at = scratch.write(at, "ranked").withColumn("range", F.shiftright("at", 33))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = at.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = F.col("at") - F.shiftleft("range", 33)
    return at.join(F.broadcast(bases), "range").withColumn("rank", F.col("base") + own).drop("at", "range", "base")


def _level(sources: DataFrame, share: float, most: float) -> float:
    """The words per weight at which targets of min(most * size, level * weight) sum to ``share`` times all sizes."""
    words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not words:
        return 0.0
    level, full = share * words / weights, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.lit(most) * F.col("source_size")
        n, capped, free = sources.agg(
            F.coalesce(F.sum(above.cast("int")), F.lit(0)),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if n == full or not free:
            return level
        level, full = (share * words - most * capped) / free, n


def _planned(
    docs: DataFrame, share: float, most: float, weights: tuple[int, ...], schedules: tuple[Knots, ...], key: str, text: str, source: str, keep: tuple[str, ...]
) -> DataFrame:
    """``_row``, a struct of ``keep`` (so that no name can clash), and each row's size and its place in its source."""
    scratch = Scratch(docs.sparkSession)
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit("")).cast("binary"))
    # never null, in the order of the names with null last: window and join then share one way of dealing rows out
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(">"))
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    base = docs.select(row.alias("_row"), F.col(key).alias("_key"), name.alias("_source"), word_count(F.col(text)).alias("_size"), order.alias("_order"))
    base = base.withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    buckets = scratch.write(base.groupBy("_source", "_bucket").agg(F.sum("_size").alias("words")), "buckets")
    sources = _ranked(scratch, buckets.groupBy("_source").agg(F.sum("words").alias("source_size")), "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = scratch.write(sources.select("_source", "source_size", weight.alias("weight"), (F.col("rank") % len(schedules)).alias("kind")), "sources")
    level = _level(sources, share, most)
    target = F.least(F.lit(most) * F.col("source_size"), F.lit(level) * F.col("weight"))
    sources = sources.select("_source", F.col("source_size").alias("_source_size"), target.alias("_target"), F.col("kind").alias("_kind"))
    smaller = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.select("_source", "_bucket", F.coalesce(F.sum("words").over(smaller), F.lit(0)).alias("_base"))
    bases = bases.join(sources, "_source")
    running = Window.partitionBy("_source", "_bucket").orderBy("_order", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("_within", F.coalesce(F.sum("_size").over(running), F.lit(0)))
    rows = rows.join(bases, ["_source", "_bucket"])
    return rows.withColumn("_before", F.col("_base") + F.col("_within")).withColumn("_whole", F.floor("_target"))


def _due(copy: Column, schedules: tuple[Knots, ...]) -> Column:
    """The training position of a copy's first word."""
    due = (F.col("_before") + copy * F.col("_source_size")) / F.col("_target")
    return F.coalesce(*[F.when(F.col("_kind") == k, position(due, s)) for k, s in enumerate(schedules)])


def schedule(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple[Knots, ...] = SCHEDULES,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: key, source, ``size``, ``source_size``, ``target``, ``taken``, ``position``.

    ``size`` counts words (null text: 0), ``taken`` those in the mix, repeats counted; ``position`` is the first copy's,
    null if nothing is taken. Null sources are one source, the last one. Rows with a null key are ordered by their
    text's md5 instead. Repeated rows are documents of their own. Only whole numbers decide, so reruns agree.
    """
    rows = _planned(docs, share, most, weights, schedules, key, text, source, ())
    taken = sum((copy_words(c) for c in range(1, _copies(most))), copy_words(0))
    return rows.select(
        F.col("_key").alias(key),
        F.when(F.col("_source") != ">", F.substring("_source", 2, 1 << 30)).cast(docs.schema[source].dataType).alias(source),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        taken.alias("taken"),
        F.when(taken > 0, _due(F.lit(0), schedules)).alias("position"),
    )


def _copies(most: float) -> int:
    """Copies of a document that a target of at most ``most`` times its source's size can need."""
    return max(1, math.ceil(most))


def copy_words(copy: int) -> Column:
    """Words that a document's copy brings into the mix."""
    begin = F.col("_before") + F.lit(copy) * F.col("_source_size")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_whole") - begin))


def mixed(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple[Knots, ...] = SCHEDULES,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: a row with the columns of ``docs`` for each copy taken, in order of training position.

    The copy at which a source's target is reached is cut to its first words, and ``n_chars`` follows its text.
    Texts without words bring nothing and are left out.
    """
    rows = _planned(docs, share, most, weights, schedules, key, text, source, tuple(docs.columns))
    copies = F.array(*[F.struct(copy_words(c).alias("words"), F.lit(c).alias("copy")) for c in range(_copies(most))])
    rows = rows.withColumn("_copy", F.explode(F.filter(copies, lambda c: c["words"] > 0)))
    names = {c: F.col("_row").getField(c) for c in docs.columns}
    body = names[text]
    cut = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_copy.words").cast("int")), "")
    shorter = F.col("_copy.words") < F.col("_size")
    names[text] = F.when(shorter, cut).otherwise(body)
    if "n_chars" in names:
        names["n_chars"] = F.when(shorter, F.length(cut)).otherwise(names["n_chars"]).cast(docs.schema["n_chars"].dataType)
    placed = rows.select(F.struct(*[c.alias(n) for n, c in names.items()]).alias("_row"), "_key", _due(F.col("_copy.copy"), schedules).alias("_at"))
    return placed.orderBy("_at", "_key").select("_row.*")
