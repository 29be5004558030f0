"""Tail: lines appended to growing files, as a stream.

``TailSource`` is a Python data source. Its offset is the number of bytes of each file up to its last line feed; a batch
reads the ranges between two offsets on the executors. Only growth is seen: a file that shrinks keeps its offset, and
what follows the last line feed waits until it is terminated. A mark of byte order is no part of the first line and shifts
its offset, as in a file that is read whole; lines may be of any charset that ends them at line feeds.
"""

from __future__ import annotations

import posixpath
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from linescope.functions.patterns import Pattern
from linescope.operators.search import search, search_many
from linescope.sources.files import BOM, split_lines

#: Bytes of a range that one task reads, cut at a line feed; of a file that a batch takes up; and of one read.
RANGE, PER_BATCH, BLOCK = 64 << 20, 64 << 20, 1 << 20


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store that holds a path or URI, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def terminated_size(path: str, known: int) -> int:
    """Bytes up to the last line feed, at least ``known``."""
    store, name = store_of(path)
    with store.open_input_file(name) as file:
        at = file.size()
        while at > known:
            begin = max(known, at - (1 << 16))
            file.seek(begin)
            found = file.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return known


def next_line(path: str, at: int, end: int) -> int:
    """The first line start from ``at`` on, at most ``end``."""
    store, name = store_of(path)
    with store.open_input_file(name) as file:
        file.seek(at)
        while at < end and (block := file.read(BLOCK)):
            found = block.find(b"\n")
            if found >= 0:
                return min(end, at + found + 1)
            at += len(block)
    return end


class TailReader(DataSourceStreamReader):
    """``per_batch`` bounds what a batch takes of a file (to the end of a line); the first one after a restart takes all."""

    def __init__(self, pattern: str, per_batch: int = PER_BATCH, encoding: str = ""):
        self.pattern, self.per_batch, self.encoding, self.last = pattern, per_batch, encoding, None

    def files(self) -> list[str]:
        folder, name = posixpath.split(self.pattern)
        while any(c in folder for c in "*?["):  # a wildcard in a folder's name: all below it are listed
            folder, above = posixpath.split(folder)
            name = posixpath.join(above, name)
        store, where = store_of(folder or ".")
        found = store.get_file_info(fs.FileSelector(where, allow_not_found=True, recursive="/" in name))
        names = [f.path[len(where) :].lstrip("/") for f in found if f.type == fs.FileType.File]
        return sorted(posixpath.join(folder, n) for n in names if fnmatchcase(n, name))

    def initialOffset(self) -> dict:
        self.last = {}
        return {}

    def latestOffset(self) -> dict:
        last, out = self.last or {}, dict(self.last or {})
        for path in self.files():
            known = last.get(path, 0)
            end = terminated_size(path, known)
            if self.last is not None and end > known + self.per_batch:
                end = next_line(path, known + self.per_batch, end)
            out[path] = end
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.last = {**(self.last or {}), **end}
        out = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            while begin < stop:
                cut = next_line(path, begin + RANGE, stop) if stop - begin > RANGE else stop
                out.append(Range(path, begin, cut))
                begin = cut
        return out

    def read(self, partition: Range):
        """Batches of about ``BLOCK`` bytes of lines. A file that has become shorter than planned ends where it ends."""
        store, name = store_of(partition.path)
        with store.open_input_file(name) as file:
            at, held, size = partition.begin, [], 0
            file.seek(at)
            while at + size < partition.end and (block := file.read(min(BLOCK, partition.end - at - size))):
                found = block.rfind(b"\n") + 1
                if found:
                    data = b"".join([*held, block[:found]])
                    yield self.lines(partition.path, at, data)
                    at, held, size = at + len(data), [], 0
                if found < len(block):
                    held.append(block[found:])
                    size += len(block) - found

    def lines(self, path: str, at: int, data: bytes) -> pa.RecordBatch:
        """The lines of ``data``, which ends with a line feed and begins at offset ``at``."""
        mark = len(BOM) if at == 0 and data.startswith(BOM) else 0
        begins, _, text = split_lines(data[mark:], bare=True)
        if self.encoding:
            text = pa.array([t.decode(self.encoding, "replace") for t in text.cast(pa.binary()).to_pylist()], pa.string())
        elif not _valid(data):
            text = pa.array([t.decode("utf-8", "replace") for t in text.cast(pa.binary()).to_pylist()], pa.string())
        columns = [pa.repeat(path, len(begins)), pa.array(at + mark + begins), text]
        return pa.RecordBatch.from_arrays(columns, names=["path", "byte_off", "text"])

    def commit(self, end: dict) -> None:
        pass


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linescope_tail"

    def schema(self) -> str:
        return "path string, byte_off bigint, text string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("perBatch", PER_BATCH)), self.options.get("encoding", ""))


def tail_lines(spark: SparkSession, pattern: str, per_batch: int = PER_BATCH, encoding: str = "") -> DataFrame:
    """A stream of (path, byte_off, text) of the files that match a pattern in a folder, from their beginning on.

    The folder is one that the driver and all executors see: a path, or a URI that ``pyarrow.fs`` knows. ``per_batch``
    bounds the bytes of a file in a batch. ``encoding`` is a charset by Python's name, UTF-8 if none is given; what it
    cannot decode becomes U+FFFD. UTF-16 and UTF-32 do not end lines at single bytes and are refused.
    """
    if encoding.upper().replace("_", "-").startswith(("UTF-16", "UTF-32", "UTF16", "UTF32")):
        raise ValueError("a tail cannot follow UTF-16 and UTF-32 files")
    "".encode(encoding or "utf-8")  # an unknown name fails here
    spark.dataSource.register(TailSource)
    return spark.readStream.format("linescope_tail").option("path", pattern).option("perBatch", per_batch).option("encoding", encoding).load()


def tail_numbered(stream: DataFrame) -> DataFrame:
    """The stream with ``line_no``, which runs on over batches and restarts: the state is the next number of a file.

    A batch's lines of one file are sorted in one task; the source bounds them.
    """

    def number(key, batches, state):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("byte_off")
        first = state.get[0] if state.exists else 0
        rows["line_no"] = range(first, first + len(rows))
        state.update((first + len(rows),))
        yield rows[["path", "line_no", "byte_off", "text"]]

    return stream.groupBy("path").applyInPandasWithState(number, "path string, line_no bigint, byte_off bigint, text string", "next bigint", "append", "NoTimeout")


def tail_search(stream: DataFrame, filters: dict[str, Pattern] | Pattern) -> DataFrame:
    """Hits among appended lines only, tagged by filter if there are several."""
    return search(stream, filters) if isinstance(filters, Pattern) else search_many(stream, filters)


def replay_stream(stream: DataFrame, key: str, ts: str, table: str, checkpoint: str, value: str | None = None):
    """Keep ``table`` at the latest row of each key: fold each batch into it; a row with a null ``value`` deletes its key.

    ``table`` is a folder of versions, one for each batch; the newest one holds. Deleted keys stay in it as rows with a
    null value, so that an older row that comes late does not bring them back. The version before the last is removed.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{table}/{number - 1}"))
        ties = [ts, *([F.col(value).isNull()] if value else [])]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*ties)).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{table}/{number}")
        if number > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
