"""A saved index of files: where every line is, by checkpoints, and what has been read of each file.

``refresh`` lists files and reads what an index does not know yet: new files, the appended end of grown ones, and all of
those that were rewritten or cut. Checkpoints are appended as one batch of rows, and a manifest with a row for each file is
written last; a reader takes the newest manifest and the batches up to it, so a refresh that fails changes nothing.

A checkpoint is a span of whole lines, ``(path, generation, line_no, start, stop, n)``, of about ``STRIDE`` bytes. Lookups
meet the spans by equal blocks of line numbers or of bytes, read a span's bytes and count within them. ``indexed`` is the
same table for queries: filters on path, number, offset and text are pushed into the source, which reads only spans that
can hold what is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import datasource as source_api
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linescope.sources import files
from linescope.sources.encoding import opened
from linescope.sources.lines import without_cr

#: Bytes of a checkpoint's span, and line numbers of a block in which wanted lines meet spans.
STRIDE, NUMBERS = 64 << 10, 4096
#: Bytes at either end of what was read by which a file is known again.
PROOF = 4096
MANIFEST = "path string, size long, mtime timestamp, lines long, bytes long, generation int, proof string, action string, read_bytes long"
SPANS = "path string, generation int, line_no long, start long, stop long, n long"


# --- the folder ------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, where: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, location: str) -> int:
    """The number of the newest manifest, 0 if there is none."""
    at, store = _folder(spark, f"{location}/manifest")
    if not store.exists(at):
        return 0
    done = [int(s.getPath().getName()) for s in store.listStatus(at) if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=0)


def manifest(spark: SparkSession, location: str, number: int | None = None) -> DataFrame:
    """What is known of each file: size and time, terminated ``lines`` and their ``bytes``, and what the last refresh did."""
    number = version(spark, location) if number is None else number
    if not number:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{location}/manifest/{number}")


def spans(spark: SparkSession, location: str) -> DataFrame:
    """``(path, line_no, start, stop, n)`` of all checkpoints, an unterminated last line being one of its own."""
    number = version(spark, location)
    known = manifest(spark, location, number)
    if not number:
        return spark.createDataFrame([], "path string, line_no long, start long, stop long, n long")
    saved = spark.read.schema(f"{SPANS}, v int").parquet(f"{location}/spans").where(F.col("v") <= number)
    saved = saved.join(known.select("path", "generation"), ["path", "generation"], "left_semi")
    rest = known.where("bytes < size").select("path", F.col("lines").alias("line_no"), F.col("bytes").alias("start"), F.col("size").alias("stop"), F.lit(1).cast("long").alias("n"))
    return saved.select("path", "line_no", "start", "stop", "n").unionByName(rest)


# --- refreshing ------------------------------------------------------------------------------------------------------


def proof(path: str, size: int) -> str:
    """A digest of both ends of a file's first ``size`` bytes; another one if the file has fewer."""
    ends = [b"".join(files.pieces(path, begin, end)) for begin, end in ((0, min(size, PROOF)), (max(0, size - PROOF), size))]
    return hashlib.sha256(b"|".join([*ends, str(sum(map(len, ends))).encode()])).hexdigest()


def _proofs(asked: DataFrame, size: str, out: str) -> DataFrame:
    """``asked`` (path, ...) with the proof of each file's first ``size`` bytes; nothing is read where that is null."""
    names = [*asked.columns, out]

    def read(batches):
        for b in batches:
            sizes = b.column(b.schema.get_field_index(size)).to_pylist()
            found = [None if n is None else proof(p, n) for p, n in zip(b.column(0).to_pylist(), sizes)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields]
    return asked.mapInArrow(read, ", ".join([*kinds, f"`{out}` string"]))


def _checkpoints(stride: int):
    """Of each range the starts of lines of which each is the first in its stride, and how many lines start before them."""
    names = ["path", "size", "begin", "n", "first", "last", "starts", "before", "ended"]

    def one(path: str, origin: int, begin: int, end: int) -> tuple:
        at = begin if begin == origin else begin - 1
        kept, before, n, last, tail = [], [], 0, None, b""
        if begin == origin:
            first = 3 if not begin and b"".join(files.pieces(path, 0, 3)) == files.BOM else begin
            kept, before, n, last = [first], [0], 1, first
        for data in files.pieces(path, at, end):
            stop = min(len(data), end - 1 - at)  # a line feed at the end of the range starts a line of the next one
            low = 0
            while low < stop:
                edge = (at + low + 1) // stride * stride + stride  # the next stride's first byte
                high = min(stop, edge - at - 1)
                many = data.count(b"\n", low, high)
                if many:
                    start = at + data.find(b"\n", low, high) + 1
                    if not kept or start // stride != kept[-1] // stride:
                        kept.append(start)
                        before.append(n)
                    n += many
                    last = at + data.rfind(b"\n", low, high) + 1
                low = high
            at += len(data)
            tail = data[-1:]
        return n, kept[0] if kept else None, last, kept, before, tail == b"\n"

    def read(batches):
        for b in batches:
            rows = [one(*r) for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)))]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.bool_()]
            found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *found], names=names)

    return read


CHECKED = "path string, size long, begin long, n long, first long, last long, starts array<long>, before array<long>, ended boolean"


def refresh(spark: SparkSession, paths: str | list[str], location: str, stride: int = STRIDE, width: int = files.RANGE) -> DataFrame:
    """Bring the index in ``location`` to what the files of ``paths`` are now; returns the new manifest.

    A file of the known size and time is taken as unchanged. Of one that has grown, and whose first ``size`` bytes have
    the ends that they had, only what follows its last terminated line is read. Any other file is read whole under a new
    generation, which replaces its rows. Files that ``paths`` does not list any more are left out. ``action`` says which
    of ``same``, ``grown``, ``rewritten`` and ``new`` a file was, and ``read_bytes`` what was read to number its lines.
    Files must not change while a refresh runs; what is appended meanwhile is the next one's.
    """
    number = version(spark, location)
    old = manifest(spark, location, number).select("path", *[F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "lines", "bytes", "generation", "proof")])
    now = files.listed(spark, paths).join(old, "path", "left")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    larger = (F.col("size") >= F.col("old_size")) & ~same
    now = _proofs(now.withColumn("asked", F.when(larger, F.col("old_size"))), "asked", "found")
    grown = F.col("found") == F.col("old_proof")
    action = F.when(F.col("old_size").isNull(), "new").when(same, "same").when(grown, "grown").otherwise("rewritten")
    goes_on = F.col("action").isin("same", "grown")
    zero = F.lit(0).cast("long")
    now = now.withColumn("action", action).select(
        "path",
        "size",
        "mtime",
        "action",
        F.when(goes_on, F.col("old_lines")).otherwise(zero).alias("old_lines"),
        F.when(goes_on, F.col("old_bytes")).otherwise(zero).alias("origin"),
        F.when(goes_on, F.col("old_generation")).otherwise(F.coalesce(F.col("old_generation") + 1, F.lit(0))).alias("generation"),
        F.when(F.col("action") == "same", F.col("old_proof")).alias("old_proof"),
    )
    batch = f"{location}/work/{number + 1}"
    now.write.mode("overwrite").parquet(f"{batch}-files")
    now = spark.read.schema(now.schema).parquet(f"{batch}-files")
    ranges = files.ranges_of(now.where("action <> 'same'"), width)
    ranges.mapInArrow(_checkpoints(stride), CHECKED).write.mode("overwrite").parquet(f"{batch}-ranges")
    found = spark.read.schema(CHECKED).parquet(f"{batch}-ranges")

    # a file's last line goes to the manifest unless a line feed ends it
    whole = found.groupBy("path").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max_by("ended", "begin").alias("ended"))
    whole = now.join(whole, "path", "left").withColumn("read_bytes", F.when(F.col("action") == "same", zero).otherwise(F.col("size") - F.col("origin")))
    n, ended = F.coalesce("n", zero), F.coalesce("ended", F.lit(True))
    whole = whole.withColumns({"lines": F.col("old_lines") + n - F.when(ended, 0).otherwise(1), "bytes": F.when(ended, F.when(F.col("n").isNull(), F.col("origin")).otherwise(F.col("size"))).otherwise(F.col("last"))})

    along = Window.partitionBy("path").orderBy("begin")
    base = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), zero)
    stop = F.coalesce(F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)), "size")
    rows = found.withColumns({"base": base, "stop": stop}).where("n > 0").join(whole.select("path", "generation", "old_lines", "bytes"), "path")
    rows = rows.select("*", F.posexplode("starts").alias("i", "start"))
    k = F.get("before", F.col("i"))
    upto = F.least(F.coalesce(F.get("starts", F.col("i") + 1), F.col("stop")), F.col("bytes"))
    # without its unterminated last line a file's last span has a line less
    many = F.coalesce(F.get("before", F.col("i") + 1), F.col("n")) - k - F.when((F.col("bytes") < F.col("stop")) & (F.col("i") == F.size("starts") - 1), 1).otherwise(0)
    line_no = F.col("old_lines") + F.col("base") + k
    new = rows.select("path", "generation", line_no.alias("line_no"), "start", upto.alias("stop"), many.alias("n")).where("start < stop")
    new.repartitionByRange("path", "line_no").sortWithinPartitions("path", "line_no").write.mode("overwrite").parquet(f"{location}/spans/v={number + 1}")

    size_read = F.when(F.col("action") != "same", F.col("size"))
    done = _proofs(whole.select("path", "size", "mtime", "lines", "bytes", "generation", size_read.alias("asked"), "old_proof", "action", "read_bytes"), "asked", "proof")
    done = done.select(*[F.coalesce("proof", "old_proof").alias("proof") if c == "proof" else F.col(c) for c in (f.split()[0] for f in MANIFEST.split(", "))])
    done.write.mode("overwrite").parquet(f"{location}/manifest/{number + 1}")
    at, store = _folder(spark, f"{location}/work")
    store.delete(at, True)
    return manifest(spark, location, number + 1)


# --- lookups ---------------------------------------------------------------------------------------------------------


def _read(path: str, start: int, stop: int) -> bytes:
    return b"".join(files.pieces(path, start, stop))


def _looked_up(by_number: bool):
    """Rows ``(path, start, stop, line_no, key)``, sorted by span, to those of the lines ``key`` or of the lines at offsets."""
    names = ["path", "key", "line_no", "byte_off", "n_bytes", "raw"]

    def look(batches):
        held, data, begins, lengths = None, b"", None, None
        for b in batches:
            out = [[] for _ in names]
            for path, start, stop, line_no, key in zip(*(c.to_pylist() for c in b.columns)):
                if held != (path, start):
                    held, data = (path, start), _read(path, start, stop)
                    begins, lengths, _ = files.split_lines(data)
                i = key - line_no if by_number else int(np.searchsorted(begins, key - start, "right")) - 1
                low, size = int(begins[i]), int(lengths[i])
                for column, value in zip(out, (path, key, line_no + i, start + low, size, data[low : low + size])):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            bounds = np.concatenate(([0], np.cumsum(out[4]))).astype(np.int32)
            raw = pa.StringArray.from_buffers(len(out[4]), pa.py_buffer(bounds), pa.py_buffer(b"".join(out[5])))
            yield pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(out, kinds)), raw], names=names)

    return look


def _met(spark: SparkSession, met: DataFrame, by_number: bool) -> DataFrame:
    """The lookups of spans and keys that met, each span read by one task, once."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = met.select("path", "start", "stop", "line_no", "key").repartition(n, "path", "start").sortWithinPartitions("path", "start", "key")
    found = dealt.mapInArrow(_looked_up(by_number), "path string, key long, line_no long, byte_off long, n_bytes int, raw string")
    return found.withColumn("text", without_cr(F.col("raw"))).drop("raw")


def fetch_lines(spark: SparkSession, location: str, wanted: DataFrame) -> DataFrame:
    """``get_lines`` on files: ``lines`` of the wanted (path, line_no), of whose files only the spans that hold them are read.

    A number that is asked for several times comes as often; numbers out of range give no row.
    """
    block = F.explode(F.sequence(F.floor(F.col("line_no") / NUMBERS), F.floor((F.col("line_no") + F.col("n") - 1) / NUMBERS))).alias("_block")
    blocks = spans(spark, location).select("*", block)
    asked = wanted.select("path", F.col("line_no").alias("key")).withColumn("_block", F.floor(F.col("key") / NUMBERS))
    met = asked.join(blocks, ["path", "_block"]).where("key >= line_no and key < line_no + n")
    return _met(spark, met, True).select("path", "line_no", "byte_off", "n_bytes", "text")


def lines_at(spark: SparkSession, location: str, probes: DataFrame, stride: int = STRIDE) -> DataFrame:
    """``offset_to_line`` on files: (path, offset) with the line that holds each offset, ``(path, probe, line_no, byte_off, n_bytes, text)``.

    Offsets outside a file are moved to its first or last line; files without lines have none.
    """
    bounds = spans(spark, location).groupBy("path").agg(F.min("start").alias("low"), F.max("stop").alias("high"))
    asked = probes.select("path", F.col("offset").alias("probe")).join(bounds, "path")
    asked = asked.select("path", "probe", F.greatest(F.least("probe", F.col("high") - 1), "low").alias("key")).withColumn("_block", F.floor(F.col("key") / stride))
    block = F.explode(F.sequence(F.floor(F.col("start") / stride), F.floor((F.col("stop") - 1) / stride))).alias("_block")
    met = asked.join(spans(spark, location).select("*", block), ["path", "_block"]).where("key >= start and key < stop")
    found = _met(spark, met.select("path", "start", "stop", "line_no", "key").distinct(), False)
    return asked.select("path", "probe", "key").join(found, ["path", "key"]).drop("key")


def pages_at(spark: SparkSession, location: str, probes: DataFrame, rows: int, stride: int = STRIDE) -> DataFrame:
    """``page_at`` on files: the first ``rows`` lines that start at or after each (path, offset), counted by ``turn``."""
    found = lines_at(spark, location, probes, stride)
    first = F.when(F.col("probe") <= F.col("byte_off"), F.col("line_no")).otherwise(F.col("line_no") + 1)
    numbers = F.posexplode(F.sequence(first, first + rows - 1)).alias("turn", "line_no")
    asked = found.select("path", F.col("probe").alias("offset"), numbers).withColumn("turn", F.col("turn") + 1)
    lines = fetch_lines(spark, location, asked.select("path", "line_no").distinct())
    return asked.join(lines, ["path", "line_no"])


def all_lines(spark: SparkSession, location: str, encoding: str | None = None, longest: int | None = None, width: int = files.RANGE) -> DataFrame:
    """``lines`` of all indexed files in one pass, spans of about ``width`` bytes being read at once."""
    known = spans(spark, location)
    n = known.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 1
    wide = known.groupBy("path", F.floor(F.col("start") / width)).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("line_no").alias("line_no"))
    return files.lines_of_spans(wide.repartition(files.dealt(spark, -(-n // width))), encoding, longest)


# --- a source that takes filters -------------------------------------------------------------------------------------


class Part(InputPartition):
    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


class IndexReader(DataSourceReader):
    """Reads spans that the pushed filters leave; ``low`` and ``high`` bound a column's values, ``among`` lists them."""

    def __init__(self, options: dict):
        self.location, self.number, self.tasks = options["location"], int(options["version"]), int(options["tasks"])
        self.low, self.high, self.among, self.parts = {}, {}, {}, []

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if isinstance(f, source_api.EqualTo) and name in ("path", "line_no", "byte_off"):
                self._among(name, [value])
            elif isinstance(f, source_api.In) and name in ("path", "line_no", "byte_off"):
                self._among(name, f.value)
            elif name in ("line_no", "byte_off") and isinstance(f, (source_api.GreaterThan, source_api.GreaterThanOrEqual)):
                self.low[name] = max(self.low.get(name, value), value)
            elif name in ("line_no", "byte_off") and isinstance(f, (source_api.LessThan, source_api.LessThanOrEqual)):
                self.high[name] = min(self.high.get(name, value), value)
            elif name == "text" and isinstance(f, source_api.StringContains):
                self.parts.append(value)
            yield f  # spans and blocks hold more lines than those asked for: Spark looks at each again

    def _among(self, name: str, values) -> None:
        values = {v for v in values if v is not None}
        self.among[name] = self.among[name] & values if name in self.among else values

    def partitions(self) -> list[Part]:
        store, where = fs.FileSystem.from_uri(self.location) if "://" in self.location else (fs.LocalFileSystem(), self.location.removeprefix("file:"))
        known = ds.dataset(f"{where}/manifest/{self.number}", filesystem=store).to_table(columns=["path", "generation", "size", "lines", "bytes"])
        paths = self.among.get("path")
        if paths is not None:
            known = known.filter(pc.is_in(known["path"], pa.array(sorted(paths), pa.string())))
        wish = pc.field("path").isin(known["path"].combine_chunks()) if paths is not None else pc.scalar(True)
        ends = {"line_no": ("line_no", pc.field("line_no") + pc.field("n") - 1), "byte_off": ("start", pc.field("stop") - 1)}
        for name, (begin, end) in ends.items():
            values = self.among.get(name)
            low = max([v for v in (self.low.get(name), min(values) if values else None) if v is not None], default=None)
            high = min([v for v in (self.high.get(name), max(values) if values else None) if v is not None], default=None)
            if values is not None and not values:
                return [Part([])]
            wish = wish & (end >= low) if low is not None else wish
            wish = wish & (pc.field(begin) <= high) if high is not None else wish
        columns = ["path", "generation", "line_no", "start", "stop", "n"]
        saved = ds.dataset(f"{where}/spans", filesystem=store, partitioning="hive").to_table(columns=columns, filter=wish & (pc.field("v") <= self.number))
        saved = saved.join(known.select(["path", "generation"]), ["path", "generation"], join_type="inner").select(["path", "line_no", "start", "stop", "n"])
        rest = known.filter(pc.less(known["bytes"], known["size"]))
        rest = pa.table([rest["path"], rest["lines"], rest["bytes"], rest["size"], pa.array(np.ones(len(rest), np.int64))], names=saved.column_names)
        both = pa.concat_tables([saved, rest]).sort_by([("path", "ascending"), ("start", "ascending")])
        start, stop, line_no, n = (both[c].to_numpy() for c in ("start", "stop", "line_no", "n"))
        keep = np.ones(len(both), bool)
        for name, begins, ends_ in (("line_no", line_no, line_no + n), ("byte_off", start, stop)):
            if name in self.among:
                values = np.array(sorted(self.among[name]), np.int64)
                keep &= np.searchsorted(values, begins) < np.searchsorted(values, ends_)
            keep &= (ends_ > self.low.get(name, -1)) & (begins <= self.high.get(name, np.iinfo(np.int64).max))
        rows = list(zip(both["path"].filter(pa.array(keep)).to_pylist(), *(c[keep].tolist() for c in (start, stop, line_no))))
        return [Part(p) for p in _dealt(rows, self.tasks)] or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        needles = [p.encode() for p in self.parts]
        for path, start, stop, line_no in part.pieces:
            for at, data, _ in files.whole_lines(path, start, stop):
                if not all(p in data for p in needles):
                    line_no += data.count(b"\n")
                    continue
                begins, lengths, raw = files.split_lines(data, bare=True)
                kept = np.ones(len(begins), bool)
                for name, values in (("line_no", line_no + np.arange(len(begins))), ("byte_off", at + begins)):
                    if name in self.among:
                        kept &= np.isin(values, list(self.among[name]))
                    kept &= (values >= self.low.get(name, 0)) & (values <= self.high.get(name, np.iinfo(np.int64).max))
                for p in self.parts:
                    kept &= pc.match_substring(raw, p).to_numpy(zero_copy_only=False)
                which = np.flatnonzero(kept)
                if len(which):
                    text = raw if len(which) == len(raw) else raw.take(pa.array(which))
                    columns = [pa.repeat(path, len(which)), pa.array(line_no + which), pa.array(at + begins[which]), pa.array(lengths[which].astype(np.int32)), text]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "line_no", "byte_off", "n_bytes", "text"])
                line_no += len(begins)


def _dealt(rows: list[tuple[str, int, int, int]], tasks: int) -> Iterator[list[tuple[str, int, int, int]]]:
    """Spans in order, those behind each other as one, in parts of about equal bytes: ``tasks`` of them, or so many ranges."""
    total = sum(stop - start for _, start, stop, _ in rows)
    most = max(1, min(files.RANGE, -(-total // max(1, tasks))))
    part, size = [], 0
    for path, start, stop, line_no in rows:
        if size >= most:
            yield part
            part, size = [], 0
        if part and part[-1][0] == path and part[-1][2] == start:
            part[-1] = (path, part[-1][1], stop, part[-1][3])
        else:
            part.append((path, start, stop, line_no))
        size += stop - start
    if part:
        yield part


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linescope_index"

    def schema(self) -> str:
        return "path string, line_no bigint, byte_off bigint, n_bytes int, text string"

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options)


def indexed(spark: SparkSession, location: str) -> DataFrame:
    """``lines`` of all indexed files as a table whose filters choose what is read.

    Comparisons of path, line_no and byte_off with constants leave the spans that can hold such lines; what a text must
    contain is looked for in the bytes, and only lines that have it come to Spark. It sets
    ``spark.sql.python.filterPushdown.enabled`` in the session. The index's folder is read by ``pyarrow.fs`` while the
    query is planned, as far as the filters leave row groups of it.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexSource)
    number = version(spark, location)
    if not number:
        raise ValueError(f"no index in {location}")
    return spark.read.format("linescope_index").option("location", location).option("version", number).option("tasks", spark.sparkContext.defaultParallelism).load()
