"""Lines of logs that come as a stream of segment files, whose ends may cut a line anywhere.

A log is a sequence of numbered segments. The state of a log is the segment that comes next, the number and offset of its
next line, the bytes of a line that no segment has ended yet, and segments that came before their turn. Lines come out in
order, once; a segment that comes again is dropped.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.sources.files import BOM

LINES = "path string, line_no bigint, byte_off bigint, text string"
STATE = "next bigint, line_no bigint, byte_off bigint, carry binary, waiting binary"


def segment_files(spark: SparkSession, folder: str, log: Column, number: Column, per_batch: int = 64) -> DataFrame:
    """A stream of ``(log, number, content)`` of the files in a folder; ``log`` and ``number`` are taken from ``path``.

    Files must not change once they are there, and an empty one is never seen (Spark lists none), so a log's segments
    must have a byte at least. ``per_batch`` bounds the files of a batch.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select(log.alias("log"), number.cast("long").alias("number"), "content")


def packed(segments: dict[int, bytes]) -> bytes:
    return b"".join(struct.pack("<qq", n, len(data)) + data for n, data in sorted(segments.items()))


def unpacked(raw: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at < len(raw):
        n, size = struct.unpack_from("<qq", raw, at)
        out[n] = raw[at + 16 : at + 16 + size]
        at += 16 + size
    return out


def segment_lines(segments: DataFrame, first: int = 0, encoding: str = "utf-8") -> DataFrame:
    """``lines`` of a stream ``(log, number, content)``: the segments of a log, from number ``first`` on, are one file.

    ``(path, line_no, byte_off, text)``, ``path`` being the log. Segments are put in order of their numbers, over batches
    and restarts: one that is missing holds back those behind it, which wait in the state, and one that was there before
    is ignored. A line comes when its line feed has; offsets are those of all segments put together, a UTF-8 mark of byte
    order at their beginning belongs to no line. A log's segments of one batch are put together in one task.
    """

    def carry_on(key, batches, state):
        next_, line_no, at, carry, waiting = state.get if state.exists else (first, 0, 0, b"", b"")
        waiting, carry = unpacked(bytes(waiting)), bytes(carry)
        for rows in batches:
            waiting.update({int(n): bytes(data or b"") for n, data in zip(rows["number"], rows["content"]) if n >= next_ and int(n) not in waiting})
        out, parts = [], [carry]
        while next_ in waiting:
            data = waiting.pop(next_)
            next_ += 1
            *ended, rest = data.split(b"\n")
            for line in ended:
                line = b"".join([*parts, line])
                parts = []
                size = len(line) + 1
                if at == 0 and line.startswith(BOM):
                    at, line = len(BOM), line[len(BOM) :]
                    size -= len(BOM)
                out.append((key[0], line_no, at, line.removesuffix(b"\r").decode(encoding, "replace")))
                line_no, at = line_no + 1, at + size
            parts.append(rest)
        state.update((next_, line_no, at, b"".join(parts), packed(waiting)))
        yield pd.DataFrame(out, columns=["path", "line_no", "byte_off", "text"]).astype({"line_no": "int64", "byte_off": "int64", "path": "object", "text": "object"})

    kept = segments.where(F.col("number").isNotNull() & F.col("log").isNotNull())
    return kept.groupBy("log").applyInPandasWithState(carry_on, LINES, STATE, "append", "NoTimeout")
