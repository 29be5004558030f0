"""Encodings and newline styles of files, audited as a distributed job over their heads."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE, NEWLINE_SAMPLE = 262_144, 65_536
#: Byte order marks, in the order in which they are tried.
BOMS = ((b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


def _sjis(c: int, d: int, _: int) -> int:
    """Bytes of the Shift_JIS character that begins with these bytes, 0 if none does."""
    if c < 0x80 or 0xA1 <= c <= 0xDF:
        return 1
    return 2 * ((0x81 <= c <= 0x9F or 0xE0 <= c <= 0xFC) and 0x40 <= d <= 0xFC and d != 0x7F)


def _euc(c: int, d: int, e: int) -> int:
    """The same for EUC-JP: half-width kana take two bytes, JIS X 0212 takes three."""
    if c < 0x80:
        return 1
    if c == 0x8E:
        return 2 * (0xA1 <= d <= 0xDF)
    if c == 0x8F:
        return 3 * (0xA1 <= d <= 0xFE and 0xA1 <= e <= 0xFE)
    return 2 * (0xA1 <= c <= 0xFE and 0xA1 <= d <= 0xFE)


def _scored(head: bytes, size: Callable[[int, int, int], int]) -> tuple[int, int]:
    """(invalid bytes, characters of several bytes) under an encoding; what the end may have cut is neither."""
    bad = good = i = 0
    padded = head + b"\0\0"
    while i < len(head):
        n = size(padded[i], padded[i + 1], padded[i + 2])
        if n == 0 and i + 3 > len(head) and (size(padded[i], 0xA1, 0xA1) > len(head) - i):
            break
        bad, good, i = bad + (n == 0), good + (n > 1), i + max(n, 1)
    return bad, good


def detect(head: bytes) -> tuple[str, int]:
    """(encoding, length of the byte order mark) of a file by its head."""
    for mark, name in BOMS:
        if head.startswith(mark):
            return name, len(mark)
    try:
        head.decode("utf-8")
        return "UTF-8", 0
    except UnicodeDecodeError as error:
        if error.reason == "unexpected end of data" and len(head) - error.start < 4:
            return "UTF-8", 0
    sjis, euc = _scored(head, _sjis), _scored(head, _euc)
    return ("EUC-JP", 0) if (euc[0], -euc[1]) < (sjis[0], -sjis[1]) else ("Shift_JIS", 0)


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("bom_len", T.IntegerType())]))
def detected(heads: pd.Series) -> pd.DataFrame:
    found = [detect(bytes(h) if h is not None else b"") for h in heads]
    return pd.DataFrame(found, columns=["encoding", "bom_len"])


def newline_style(head: Column) -> Column:
    """CrLf if any line ends so, else Lf, else Cr; without a line end Lf."""
    return F.when(head.contains("\r\n"), "CrLf").when(head.contains("\n"), "Lf").when(head.contains("\r"), "Cr").otherwise("Lf")


def heads(spark: SparkSession, paths: str | list[str], sample: int = SAMPLE) -> DataFrame:
    """``(path, size, head)``: the first bytes of each file, of which no more is read.

    Spark lists the files; tasks open them with ``pyarrow.fs``, which knows local, Hadoop and object stores by their URI.
    """

    def read(batches):
        for b in batches:
            found = [_head(path, sample) for path in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=["path", "size", "head"])

    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))
    return files.mapInArrow(read, "path string, size long, head binary")


def opened(path: str):
    """A file of a local path or URI, for reading."""
    if path.startswith("file:"):
        store, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        store, name = fs.FileSystem.from_uri(quote(path, safe=":/@?&="))
    return store.open_input_file(name)


def _head(path: str, sample: int) -> bytes:
    with opened(path) as file:
        return file.read(sample)


def profile_files(spark: SparkSession, paths: str | list[str], sample: int = SAMPLE) -> DataFrame:
    """``files``: (path, size, bom_len, has_bom, encoding, newline), one row per file."""
    found = heads(spark, paths, sample).withColumn("d", detected("head"))
    text = F.decode(F.substring("head", 1, NEWLINE_SAMPLE), "ISO-8859-1")
    return found.select("path", "size", "d.bom_len", (F.col("d.bom_len") > 0).alias("has_bom"), "d.encoding", newline_style(text).alias("newline"))


def detect_newline(spark: SparkSession, paths: str | list[str], sample: int = NEWLINE_SAMPLE) -> DataFrame:
    return heads(spark, paths, sample).select("path", newline_style(F.decode("head", "ISO-8859-1")).alias("newline"))
