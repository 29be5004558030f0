"""Lines of files and of text columns, their numbers and offsets.

``lines`` has (path, line_no, byte_off, n_bytes, text): a line ends at a line feed only, one carriage return before it
is not part of ``text``, and ``n_bytes`` is what stands before the line feed. A last line feed opens no further line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linescope.functions.arrays import sums_before

#: Blocks of files up to which their sums are broadcast, a row each.
FEW_BLOCKS = 100_000


def without_cr(raw: Column) -> Column:
    return F.when(raw.endswith("\r"), raw.substr(F.lit(1), F.length(raw) - 1)).otherwise(raw)


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """``(path, block, seq, raw, text)`` of every line of the files; ``seq`` ascends within a block of a file.

    Splitting is left to the text source, so a large file is read by many tasks. ``encoding`` decodes lines of another
    charset (see ``decode_lines``); UTF-16 and UTF-32 files do not split at line feeds and are refused.
    """
    if encoding and encoding.upper().replace("_", "-").startswith(("UTF-16", "UTF-32")):
        raise ValueError("the text source splits at single bytes: numbered_files reads UTF-16 and UTF-32")
    found = spark.read.option("lineSep", "\n").text(paths)
    found = found.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("raw"),
        without_cr(F.col("value")).alias("text"),
    )
    return decode_lines(found, encoding) if encoding else found


def decode_lines(raw_lines: DataFrame, encoding: str) -> DataFrame:
    """The same lines with ``text`` decoded anew from ``raw``; numbers and offsets do not change.

    Charsets beyond Spark's own (MS932, EUC-JP) need ``spark.sql.legacy.javaCharsets`` set in the session.
    """
    return raw_lines.withColumn("text", without_cr(F.decode(F.col("raw").cast("binary"), encoding)))


def number_lines(raw_lines: DataFrame, boms: DataFrame | None = None) -> DataFrame:
    """``lines`` with exact numbers and byte offsets, in two passes that shuffle no text.

    The first pass sums up bytes and lines of each block and adds the sums up along the files. The second numbers lines
    within their block as they are read, in order, and adds the block's base. Bases are one row per block, at most as many
    as the scan has files and tasks; they are broadcast if these are ``FEW_BLOCKS`` or fewer, else Spark chooses the join. Call
    it on ``read_lines`` itself: rows that are missing or out of their order make it fail.
    ``boms`` (path, bom_len) shifts offsets by a byte order mark that the reader has dropped.
    """
    ident = F.xxhash64("path", "block").alias("ident")
    blocks = raw_lines.groupBy("path", "block").agg(F.sum(F.octet_length("raw").cast("long") + 1).alias("bytes"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = blocks.select("path", ident, F.coalesce(F.sum("bytes").over(before), zero).alias("b0"), F.coalesce(F.sum("n").over(before), zero).alias("n0"))
    if boms is not None:
        bases = bases.join(boms.select("path", "bom_len"), "path", "left").withColumn("b0", F.col("b0") + F.coalesce("bom_len", F.lit(0))).drop("bom_len")
    if len(raw_lines.inputFiles()) + raw_lines.rdd.getNumPartitions() <= FEW_BLOCKS:
        bases = F.broadcast(bases)
    rows = raw_lines.select(ident, "seq", F.octet_length("raw").alias("n_bytes"), "text")
    rows = rows.mapInArrow(_numbered, "ident long, k long, at long, n_bytes int, text string")
    return rows.join(bases, "ident").select(
        "path", (F.col("n0") + F.col("k")).alias("line_no"), (F.col("b0") + F.col("at")).alias("byte_off"), "n_bytes", "text"
    )


def _numbered(batches):
    """Number and offset of each line within its block; a block's lines come one after another."""
    last, seq, lines, total = None, None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        block, order = b.column(0).to_numpy(), b.column(1).to_numpy()
        sizes = b.column(2).to_numpy().astype(np.int64) + 1
        if (np.diff(order) != 1).any() or (seq is not None and order[0] != seq + 1):
            raise ValueError("number_lines needs all lines as read_lines gives them, none dropped or moved")
        first = np.append(True, block[1:] != block[:-1])
        starts = np.flatnonzero(first)
        owner = np.cumsum(first) - 1
        before = np.cumsum(sizes) - sizes
        k, at = np.arange(len(sizes)) - starts[owner], before - before[starts[owner]]
        if last == block[0]:  # the batch goes on with a block
            end = starts[1] if len(starts) > 1 else len(sizes)
            k[:end] += lines
            at[:end] += total
        last, seq, lines, total = block[-1], int(order[-1]), int(k[-1]) + 1, int(at[-1] + sizes[-1])
        columns = [b.column(0), pa.array(k), pa.array(at), b.column(2), b.column(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["ident", "k", "at", "n_bytes", "text"])


def lines_from_column(df: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """``lines`` of a text column, one value being one file: (key..., line_no, byte_off, n_bytes, text).

    A value's lines stay where it is: offsets are sums over the array of its lines, and nothing is shuffled. Null and
    empty values have no lines.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cut = df.where(F.length(text) > 0).select(*keys, F.split(F.col(text), "\n", -1).alias("_lines"))
    # a last line feed opens no further line
    last = F.size("_lines") - (F.element_at("_lines", -1) == "").cast("int")
    cut = cut.select(*keys, F.slice("_lines", F.lit(1), last).alias("_lines"))
    offsets = sums_before(F.transform("_lines", lambda x: F.octet_length(x).cast("bigint") + 1))
    both = F.arrays_zip(F.col("_lines").alias("raw"), offsets.alias("byte_off"))
    rows = cut.select(*keys, F.posexplode(both).alias("line_no", "_line"))
    raw = F.col("_line.raw")
    return rows.select(*keys, F.col("line_no").cast("long").alias("line_no"), F.col("_line.byte_off").alias("byte_off"), F.octet_length(raw).alias("n_bytes"), without_cr(raw).alias("text"))


def file_stats(lines: DataFrame, by: str | list[str] = "path", files: DataFrame | None = None) -> DataFrame:
    """Per file: ``total_lines``, the lines' ``size`` with line feeds, and shortest and longest line in bytes.

    Lines alone say nothing of files without any: with ``files``, which has the keys, each of them has a row, with zeros
    and nulls if it has no lines.
    """
    keys = [by] if isinstance(by, str) else by
    found = lines.groupBy(*keys).agg(
        F.count("*").alias("total_lines"), F.sum(F.col("n_bytes") + 1).cast("long").alias("size"), F.min("n_bytes").alias("min_bytes"), F.max("n_bytes").alias("max_bytes")
    )
    return found if files is None else with_all(found, files, keys, ("total_lines", "size"))


def with_all(found: DataFrame, files: DataFrame, keys: list[str], counts: tuple[str, ...]) -> DataFrame:
    """A row of ``found`` for each key of ``files``; where there is none, ``counts`` are 0 and the rest null."""
    joined = files.select(*keys).join(found, keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})


def line_checkpoints(lines: DataFrame, files: DataFrame, every: int = 256) -> DataFrame:
    """Sparse offsets ``(path, k, line_no, byte_off)`` of every ``every``-th line.

    ``files`` (path, size, total_lines, terminated) adds the boundary at the end of a terminated file whose line count
    is a multiple of ``every``; an empty file has the checkpoint of its beginning.
    """
    own = lines.where(F.col("line_no") % every == 0).select("path", (F.col("line_no") / every).cast("long").alias("k"), "line_no", "byte_off")
    ends = files.where(((F.col("total_lines") % every == 0) & F.col("terminated")) | (F.col("total_lines") == 0))
    return own.union(ends.select("path", (F.col("total_lines") / every).cast("long"), F.col("total_lines"), F.col("size")))


def save_lines_table(lines: DataFrame, location: str, partitions: int | None = None) -> None:
    """Persist numbered lines, sorted by path and line, so that Parquet statistics prune reads by line or offset."""
    dealt = lines.repartitionByRange(partitions, "path", "line_no") if partitions else lines.repartitionByRange("path", "line_no")
    dealt.sortWithinPartitions("path", "line_no").write.mode("overwrite").parquet(location)


def open_lines_table(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.parquet(location)


SEPARATOR = "⋯"


def rendered(result_rows: DataFrame, line_numbers: bool = True) -> DataFrame:
    """``result_rows`` with ``out``, a row as exported: grouped 1-based number, tab and text, or the separator."""
    body = F.concat(F.format_number(F.col("line_no") + 1, 0), F.lit("\t"), F.col("text")) if line_numbers else F.col("text")
    return result_rows.withColumn("out", F.when(F.col("kind") == "separator", F.lit(SEPARATOR)).otherwise(body))


def write_lines(result_rows: DataFrame, location: str, line_numbers: bool = True) -> None:
    """Write result rows as UTF-8 text in order of (path, row_no); part files follow that order."""
    rendered(result_rows, line_numbers).orderBy("path", "row_no").select("out").write.mode("overwrite").text(location)
