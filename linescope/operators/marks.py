"""Where hits and bookmarks lie in files, and folds of histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from linescope.plans.ordered import running_sum


def hit_histogram(hits: DataFrame, files: DataFrame, buckets: int) -> DataFrame:
    """Hits by place along the file: ``y`` from 0 to ``buckets``, with their number."""
    y = F.least(F.greatest(F.floor(F.col("byte_off") * buckets / F.col("size")), F.lit(0)), F.lit(buckets))
    placed = hits.join(files.select("path", "size"), "path")
    return placed.groupBy("path", y.alias("y")).agg(F.count("*").alias("n"))


def mark_positions(marks: DataFrame, files: DataFrame) -> DataFrame:
    """Each mark's share of its file's size."""
    return marks.join(files.select("path", "size"), "path").withColumn("share", F.col("byte_off") / F.col("size"))


def toggle_fold(log: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The keys toggled an odd number of times, with the time of their last toggle."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.max(ts).alias("last")).where("n % 2 = 1").drop("n")


def replay_edits(log: DataFrame, key: str, value: str, ts: str, tie: str, first: bool = False, width: int = 86_400) -> DataFrame:
    """The table that a log of edits leaves: the last value of each key, keys whose last value is null being deleted.

    ``place`` counts keys from 1 in order of their last put or, with ``first``, of the first put since the key was last
    deleted; the log's rows are ordered by ``ts`` and ``tie``. ``width`` is in the seconds (or numbers) of ``ts``.
    """
    at = F.struct(F.col(ts).alias("t"), F.col(tie).alias("e"))
    newest = F.max_by(F.struct(F.col(value).alias("v"), at.alias("at")), at).alias("s")
    last = log.groupBy(key).agg(newest, F.max(F.when(F.col(value).isNull(), at)).alias("gone"))
    kept = last.where("s.v is not null")
    if first:
        puts = log.where(F.col(value).isNotNull()).select(key, at.alias("put")).join(kept.select(key, "gone"), key)
        puts = puts.where(F.col("gone").isNull() | (F.col("put") > F.col("gone"))).groupBy(key).agg(F.min("put").alias("put"))
        kept = kept.join(puts, key)
    else:
        kept = kept.withColumn("put", F.col("s.at"))
    second = F.col("put.t") if isinstance(log.schema[ts].dataType, NumericType) else F.col("put.t").cast("timestamp")
    rows = kept.select(key, F.col("s.v").alias(value), F.col("s.at.t").alias("ts"), F.col("s.at.e").alias(tie), second.cast("long").alias("_second"), "put")
    return running_sum(rows, F.lit(1).cast("long"), "_second", "place", ties=("put",), by=(), width=width).drop("_second", "put")


def mru(events: DataFrame, owner: str, item: str, ts: str, k: int, live: DataFrame | None = None) -> DataFrame:
    """Per owner the ``k`` most recently used items, newest first; with ``live`` only items that still exist."""
    used = events.groupBy(owner, item).agg(F.max(ts).alias("last"))
    if live is not None:
        used = used.join(live, item, "left_semi")
    turn = F.row_number().over(Window.partitionBy(owner).orderBy(F.col("last").desc(), item))
    return used.withColumn("place", turn).where(F.col("place") <= k)


def latest_state(states: DataFrame, files: DataFrame, ts: str, k: int = 500) -> DataFrame:
    """The newest state of each path, if the file still has that size and time; of those the ``k`` newest."""
    names = [c for c in states.columns if c != "path"]
    newest = states.groupBy("path").agg(F.max_by(F.struct(*names), F.struct(ts, *[c for c in names if c != ts])).alias("s")).select("path", "s.*")
    return newest.join(files.select("path", "size", "mtime"), ["path", "size", "mtime"]).orderBy(F.col(ts).desc(), "path").limit(k)
