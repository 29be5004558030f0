"""Token ids of a corpus as ORC tables, and metadata-pruned reads of them.

Documents are range-partitioned by id, so file k holds smaller ids than file k+1 and rows ascend within it. ORC stores
ids by integer run-length encoding in stripes that can be read in parallel, with a row index every ``stride`` rows and a
Bloom filter on the document id, by which a lookup skips stripes and row groups.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linescope.llm import tokens
from linescope.llm.common import partitions


def _stored(key: str, kind: T.DataType) -> T.StructType:
    fields = [(key, kind), ("part", T.IntegerType()), ("at", T.LongType()), ("n_tokens", T.LongType())]
    return T.StructType([T.StructField(*f) for f in fields] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def write_ids(
    docs: DataFrame,
    location: str,
    vocabulary: str | None = None,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    stride: int = 10_000,
    stripe_bytes: int = 64 << 20,
) -> None:
    """Encode whole texts, append ``end_id`` to each and write them to ``location`` in ascending order of ``key``.

    Null texts are empty: they have the end id alone. Rows without a key come first; rows of one key are ordered by
    their text. Only ``key`` and ``text`` are read. Stored: key, ``part`` (the file's rank), ``at`` (ids before the
    document in its file), ``n_tokens`` and ``ids``.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()
    schema = _stored(key, docs.schema[key].dataType)

    def encode(batches):
        at, part, encoder = 0, TaskContext.get().partitionId(), tokens.encoder(vocabulary)
        for b in (s for batch in batches for s in tokens.slices(batch, 1)):
            ids, bounds = encoder.encode(b.column(1))
            ends = bounds[1:] + np.arange(1, b.num_rows + 1)
            ids = np.insert(ids.astype(np.int32), bounds[1:], end_id)
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            places = pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at + offsets[:-1].astype(np.int64))
            sizes = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), *places, sizes, lists], names=schema.names)
            at += int(ends[-1])

    ordered = docs.select(key, text).repartitionByRange(partitions(docs.sparkSession), key).sortWithinPartitions(key, text)
    (
        ordered.mapInArrow(encode, schema)
        .write.mode("overwrite")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", stride)
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.bloom.filter.columns", key)
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(location)
    )


def read_ids(spark: SparkSession, location: str, key: str = "doc_id", kind: T.DataType | None = None) -> DataFrame:
    """The stored rows with ``start``, the number of ids of all documents before. A filter on ``key`` prunes stripes."""
    stored = spark.read.schema(_stored(key, kind or T.LongType())).orc(location)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return stored.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("at")).drop("base")


def digests(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of rows of ``read_ids``."""
    kind = stored.schema[key].dataType

    def digest(batches):
        for b in batches:
            lists = b.column(3)
            ids, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.asarray(lists.offsets)
            at = (at - at[0]).tolist()
            crc = [zlib.crc32(ids[s:e]) for s, e in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")])
    return stored.select(key, "start", "n_tokens", "ids").mapInArrow(digest, schema)
