"""Numbered lines of UTF-16 and UTF-32 files, read in ranges of whole code units.

A line feed is a code unit there, not a byte: 0x0A is half of many other characters. So ranges begin at multiples of four
bytes, line feeds are looked for among code units, and all else is as ``sources.files`` has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.sources import files


@dataclass(frozen=True)
class Units:
    """A charset's code units: their type, Python's name of it, and the mark of byte order that a file may begin with."""

    kind: str
    codec: str
    mark: bytes

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize

    def feeds(self, data: bytes) -> np.ndarray:
        """The offsets in bytes behind each line feed."""
        whole = len(data) // self.size
        return (np.flatnonzero(np.frombuffer(data, self.kind, whole) == 10) + 1) * self.size


#: The charsets that are known, by name.
CHARSETS = {
    "UTF-16LE": Units("<u2", "utf-16-le", b"\xff\xfe"),
    "UTF-16BE": Units(">u2", "utf-16-be", b"\xfe\xff"),
    "UTF-32LE": Units("<u4", "utf-32-le", b"\xff\xfe\x00\x00"),
    "UTF-32BE": Units(">u4", "utf-32-be", b"\x00\x00\xfe\xff"),
}


def starts(units: Units, path: str, origin: int, begin: int, end: int) -> tuple[int, int | None, int | None]:
    """``files.starts`` among code units."""
    n, first, last, at = 0, None, None, begin - units.size
    if begin == origin:
        marked = b"".join(files.pieces(path, 0, len(units.mark))) == units.mark
        first = last = len(units.mark) if marked else origin
        n, at = 1, begin
    for data in files.pieces(path, at, end - units.size):
        found = units.feeds(data)
        if len(found):
            n += len(found)
            first = at + int(found[0]) if first is None else first
            last = at + int(found[-1])
        at += len(data)
    return n, first, last


def measured(ranges: DataFrame, units: Units) -> DataFrame:
    """``files.measured`` among code units."""

    def measure(batches):
        for b in batches:
            rows = [starts(units, *r) for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)))]
            found = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *found], names=["path", "size", "begin", "n", "first", "last"])

    return ranges.mapInArrow(measure, "path string, size long, begin long, n long, first long, last long")


def whole_lines(units: Units, path: str, start: int, stop: int, block: int = files.BLOCK) -> Iterator[tuple[int, bytes]]:
    """(offset, lines) of a span; a line longer than a block has its pieces joined once."""
    held, size, at = [], 0, start
    for data in files.pieces(path, start, stop, block // 4 * 4):
        found = units.feeds(data)
        if len(found):
            cut = int(found[-1])
            yield at, b"".join([*held, data[:cut]])
            at += size + cut
            held, size, data = [], 0, data[cut:]
        if data:
            held.append(data)
            size += len(data)
        if size > files.LONGEST:
            raise ValueError(f"a line of more than {files.LONGEST} bytes at {at} of {path}")
    if held:
        yield at, b"".join(held)


def split_lines(units: Units, data: bytes) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where lines start in ``data``, their bytes without line feeds, and their texts without a carriage return at the end."""
    ends = units.feeds(data)
    closed = len(ends) > 0 and ends[-1] == len(data)
    begins = np.concatenate(([0], ends[:-1] if closed else ends)).astype(np.int64)
    stops = ends - units.size if closed else np.append(ends - units.size, len(data))
    texts = data.decode(units.codec, "replace").split("\n")
    texts = texts[:-1] if closed else texts
    if len(texts) != len(begins):  # what is no character has taken a line feed with it
        texts = [data[a:b].decode(units.codec, "replace") for a, b in zip(begins.tolist(), stops.tolist())]
    return begins, stops - begins, [t.removesuffix("\r") for t in texts]


def _lines(units: Units):
    names = ["path", "line_no", "byte_off", "n_bytes", "text"]

    def read(batches):
        for b in batches:
            for path, start, stop, line_no in zip(*(c.to_pylist() for c in b.columns)):
                for at, data in whole_lines(units, path, start, stop):
                    begins, lengths, texts = split_lines(units, data)
                    n = len(begins)
                    text = pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(np.arange(line_no, line_no + n)), pa.array(at + begins), pa.array(lengths.astype(np.int32)), text], names=names)
                    line_no += n

    return read


def wide_files(spark: SparkSession, paths: str | list[str], encoding: str, width: int = files.RANGE) -> DataFrame:
    """``lines`` of files in UTF-16 or UTF-32, of either byte order (``CHARSETS``), with exact numbers and byte offsets.

    A mark of byte order is no part of the first line and shifts its offset. ``n_bytes`` and offsets are those of the
    file; what cannot be decoded becomes U+FFFD. A range of bytes is one task's, as in ``numbered_files``.
    """
    units = CHARSETS.get(encoding.upper().replace("_", "-"))
    if not units:
        raise ValueError(f"{encoding!r} is none of {', '.join(CHARSETS)}")
    ranges = files.ranges_of(files.listed(spark, paths).withColumn("origin", F.lit(0).cast("long")), max(4, width // 4 * 4))
    spans = files.spans_of(measured(ranges, units)).repartition(ranges.rdd.getNumPartitions())
    fields = "path string, line_no long, byte_off long, n_bytes int, text string"
    return spans.select("path", "start", "stop", "line_no").mapInArrow(_lines(units), fields)
