"""Numbered lines of files, read in ranges that come as Arrow batches.

Files are listed by Spark and cut into ranges of bytes, which are rows of a table; nothing is gathered at the driver. A
first pass finds out of each range's own bytes how many lines start in it and where the first one does. Sums along a file
number the lines, and a range's lines end where the next range's first one starts, so the pass that reads the lines knows
what to read and looks for no line start: a line that goes over many ranges is read once, by one task, in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linescope.sources.encoding import opened
from linescope.sources.lines import without_cr

#: Bytes of a range, and of one read within it.
RANGE, BLOCK = 64 << 20, 4 << 20
BOM = b"\xef\xbb\xbf"
#: Bytes that a line may have: an Arrow array and a row of Spark hold no more.
LONGEST = (1 << 31) - 64


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, size, mtime)`` of files, as Spark lists them."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def ranges_of(files: DataFrame, width: int = RANGE) -> DataFrame:
    """``(path, size, origin, begin, end)``: the bytes of ``files`` (path, size, origin) from ``origin`` on, dealt over tasks.

    ``origin`` is where a line starts. One task takes few ranges: there are as many tasks as ranges, up to eight for each
    core.
    """
    some = files.where("size > origin")
    n = some.agg(F.sum(F.ceil((F.col("size") - F.col("origin")) / width))).first()[0] or 1
    cut = some.select("*", F.explode(F.sequence("origin", F.col("size") - 1, F.lit(width).cast("long"))).alias("begin"))
    cut = cut.select("path", "size", "origin", "begin", F.least(F.col("begin") + width, "size").alias("end"))
    return cut.repartition(dealt(files.sparkSession, n))


def dealt(spark: SparkSession, n: int) -> int:
    """Tasks for ``n`` ranges."""
    return max(1, min(int(n), 8 * spark.sparkContext.defaultParallelism))


def pieces(path: str, begin: int, end: int, block: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a file from ``begin`` to ``end``, or to where the file ends."""
    with opened(path) as file:
        file.seek(begin)
        while begin < end and (data := file.read(min(block, end - begin))):
            yield data
            begin += len(data)


def starts(path: str, origin: int, begin: int, end: int) -> tuple[int, int | None, int | None]:
    """How many lines start in a range, and where the first and the last of them do; a mark of byte order is no line's."""
    n, first, last, at = 0, None, None, begin - 1
    if begin == origin:
        first, n, at = origin, 1, begin
        if not begin and b"".join(pieces(path, 0, 3)) == BOM:
            first = min(3, end)
        last = first
    for data in pieces(path, at, end - 1):
        found = data.count(b"\n")
        if found:
            n += found
            first = at + data.find(b"\n") + 1 if first is None else first
            last = at + data.rfind(b"\n") + 1
        at += len(data)
    return n, first, last


def measured(ranges: DataFrame) -> DataFrame:
    """``(path, size, begin, n, first, last)``: lines that start in each range, from the range's own bytes."""

    def measure(batches):
        for b in batches:
            rows = [starts(*r) for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)))]
            found = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *found], names=["path", "size", "begin", "n", "first", "last"])

    return ranges.mapInArrow(measure, "path string, size long, begin long, n long, first long, last long")


def spans_of(found: DataFrame) -> DataFrame:
    """``(path, start, stop, line_no)``: the bytes of the lines that start in each range, and the first one's number.

    A range without a line start belongs to the line before. Windows run over one row for each range.
    """
    along = Window.partitionBy("path").orderBy("begin")
    line_no = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    stop = F.coalesce(F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)), "size")
    spans = found.select("path", F.col("first").alias("start"), stop.alias("stop"), line_no.alias("line_no"), "n")
    return spans.where("n > 0").drop("n")


def whole_lines(path: str, start: int, stop: int, longest: int | None = None, block: int = BLOCK) -> Iterator[tuple[int, bytes, int]]:
    """(offset, lines, bytes cut) of a span: lines end with a line feed, but for the last one of a file.

    A line longer than a block comes alone, its pieces joined once. Of one longer than ``longest`` the first bytes are
    kept and the others counted; without ``longest`` it is an error if it does not fit a row.
    """
    limit = LONGEST if longest is None else longest
    held, size, lost, at = [], 0, 0, start  # pieces of the line in hand, their bytes, and its bytes that are not held

    def hold(data: bytes) -> None:
        nonlocal size, lost
        kept = data[: max(0, limit - size)] if size + len(data) > limit else data
        if len(kept) < len(data) and longest is None:
            raise ValueError(f"a line of more than {limit} bytes at {at} of {path}: give longest= to cut it")
        held.append(kept)
        size, lost = size + len(kept), lost + len(data) - len(kept)

    for data in pieces(path, start, stop, block):
        if held:
            found = data.find(b"\n")
            hold(data if found < 0 else data[:found])
            if found < 0:
                continue
            yield at, b"".join([*held, b"\n"]), lost
            at += size + lost + 1
            held, size, lost, data = [], 0, 0, data[found + 1 :]
        found = data.rfind(b"\n") + 1
        if found:
            yield at, data[:found], 0
            at += found
        if found < len(data):
            hold(data[found:])
    if held:
        yield at, b"".join(held), lost


def split_lines(data: bytes, bare: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where lines start in ``data``, their lengths, and the lines without their line feeds; ``bare`` drops a carriage return too."""
    codes = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(codes == 10)
    if not len(ends) or ends[-1] != len(codes) - 1:
        ends = np.append(ends, len(codes))
    begins = np.concatenate(([0], ends[:-1] + 1))
    lengths = kept = ends - begins
    if bare and b"\r" in data:
        filled = np.flatnonzero(lengths)
        returns = ends[filled[codes[ends[filled] - 1] == 13]] - 1
        kept = lengths - np.bincount(np.searchsorted(ends, returns), minlength=len(ends))
        left = codes != 10
        left[returns] = False
        text = pa.py_buffer(codes[left])
    else:
        text = pa.py_buffer(data.translate(None, b"\n") if len(ends) > 1 else data)
    bounds = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
    return begins, lengths, pa.StringArray.from_buffers(len(ends), pa.py_buffer(bounds), text)


def _lines(longest: int | None, bare: bool):
    names = ["path", "line_no", "byte_off", "n_bytes", "text"]

    def read(batches):
        for b in batches:
            for path, start, stop, line_no in zip(*(c.to_pylist() for c in b.columns)):
                for at, data, lost in whole_lines(path, start, stop, longest):
                    begins, lengths, text = split_lines(data, bare)
                    n = len(begins)
                    if lost or (longest is not None and int(lengths.max()) > longest):
                        text = _cut(text, longest)
                    sizes = np.minimum(lengths + lost, (1 << 31) - 1).astype(np.int32)
                    columns = [pa.repeat(path, n), pa.array(np.arange(line_no, line_no + n)), pa.array(at + begins), pa.array(sizes), text]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    line_no += n

    return read


def whole_characters(raw: bytes, most: int) -> bytes:
    """At most ``most`` bytes, without a UTF-8 character that they would cut."""
    raw = raw[:most]
    tail = next((i for i in range(1, min(4, len(raw)) + 1) if raw[-i] & 0xC0 != 0x80), 0)
    lead = raw[-tail] if tail else 0
    needs = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    return raw[:-tail] if needs > tail else raw


def _cut(text: pa.Array, longest: int) -> pa.Array:
    kept = [whole_characters(t, longest) for t in text.cast(pa.binary()).to_pylist()]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in kept]))).astype(np.int32)
    return pa.StringArray.from_buffers(len(kept), pa.py_buffer(bounds), pa.py_buffer(b"".join(kept)))


def lines_of_spans(spans: DataFrame, encoding: str | None = None, longest: int | None = None) -> DataFrame:
    """``lines`` of spans ``(path, start, stop, line_no)``, each read by one task."""
    fields = "path string, line_no long, byte_off long, n_bytes int, text string"
    # a carriage return goes where lines are cut, unless its byte may be part of a character
    lines = spans.select("path", "start", "stop", "line_no").mapInArrow(_lines(longest, not encoding), fields)
    return lines.withColumn("text", without_cr(F.decode(F.col("text").cast("binary"), encoding))) if encoding else lines


def numbered_files(spark: SparkSession, paths: str | list[str], encoding: str | None = None, width: int = RANGE, longest: int | None = None) -> DataFrame:
    """``lines`` of whole files with exact numbers and byte offsets.

    The same lines as ``number_lines(read_lines(...))``, in less time: nothing goes to Python and back. A UTF-8 byte
    order mark is no part of the first line and shifts its offset. ``encoding`` decodes another charset, as there;
    UTF-16LE, UTF-16BE, UTF-32LE and UTF-32BE are read by code units (``sources.wide``).
    A line that fits no row (2 GB) is an error; with ``longest`` lines are cut to that many bytes, whole characters being
    kept, and ``n_bytes`` still is what the file has (2^31 - 1 at most). Files are opened by tasks with ``pyarrow.fs``;
    compressed files are left to ``read_lines``. Files whose numbers are wanted more than once are better indexed
    (``sources.index``), which saves the first pass.
    """
    if encoding and encoding.upper().replace("_", "-").startswith(("UTF-16", "UTF-32")):
        from linescope.sources.wide import wide_files  # it is built on this module

        if longest is not None:
            raise ValueError("lines of UTF-16 and UTF-32 files are not cut")
        return wide_files(spark, paths, encoding, width)
    ranges = ranges_of(listed(spark, paths).withColumn("origin", F.lit(0).cast("long")), width)
    spans = spans_of(measured(ranges)).repartition(ranges.rdd.getNumPartitions())
    return lines_of_spans(spans, encoding, longest)
