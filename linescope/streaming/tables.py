"""Tables that a stream keeps: hits that are appended once, and the newest row of each key, rewritten by buckets.

A batch that is run again after a failure has the same number and the same rows, so what it writes goes under its number,
and a table is what its newest complete manifest, or its complete batches, say it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _store(spark: SparkSession, where: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def complete(spark: SparkSession, where: str) -> list[int]:
    """The numbers of the folders in ``where`` that were written to their end, ascending."""
    at, store = _store(spark, where)
    if not store.exists(at):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath() for s in store.listStatus(at)]
    return sorted(int(p.getName().rpartition("=")[2]) for p in names if p.getName().rpartition("=")[2].isdigit() and store.exists(path(p, "_SUCCESS")))


def _drop(spark: SparkSession, where: str) -> None:
    at, store = _store(spark, where)
    store.delete(at, True)


# --- hits ------------------------------------------------------------------------------------------------------------


def append_hits(stream: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Append each batch of hits to ``table``, exactly once.

    A batch goes to the folder of its number. One that was written to its end and is run again, as its success was not
    noted, is left as it is; one that was not is written anew. ``open_hits`` sees complete batches only.
    """

    def put(batch: DataFrame, number: int) -> None:
        if number not in complete(batch.sparkSession, table):
            batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def open_hits(spark: SparkSession, table: str, schema) -> DataFrame:
    """The hits that ``append_hits`` has written, with ``batch``; a batch that is being written is not seen."""
    done = complete(spark, table)
    if not done:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(schema).option("basePath", table).parquet(*[f"{table}/batch={n}" for n in done])


# --- the newest row of each key --------------------------------------------------------------------------------------


def _manifest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """Of each bucket the batch whose folder has its rows, as of the newest manifest, or the newest one before a batch."""
    done = [n for n in complete(spark, f"{table}/manifest") if before is None or n < before]
    if not done:
        return {}
    return {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{table}/manifest/{done[-1]}").collect()}


def _rows(spark: SparkSession, table: str, schema, known: dict[int, int]) -> DataFrame | None:
    folders = [f"{table}/data/{batch}/bucket={bucket}" for bucket, batch in sorted(known.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else None


def upsert_stream(stream: DataFrame, key: str, ts: str, table: str, checkpoint: str, value: str | None = None, buckets: int = 64) -> DataStreamWriter:
    """Keep ``table`` at the latest row of each key; a row with a null ``value`` deletes its key.

    Rows are dealt into ``buckets`` by a hash of their key. A batch reads and rewrites the buckets of its own keys only,
    under its number, and then writes a manifest of the folders that hold; so what is written follows the keys that have
    changed, readers see one batch or the next, and a batch that fails halfway is as if it had not been. Of rows of one
    time a deletion wins, then the largest. Deleted keys stay as rows with a null value, so that an older row that comes
    late does not bring them back. Folders that neither of the last two manifests names are removed.
    """
    if not 1 <= buckets <= 100_000:
        raise ValueError("the manifest has a row for each bucket: at most 100,000")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def fold(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
            known = _manifest(spark, table, number)
            before = _rows(spark, table, schema, {b: n for b, n in known.items() if b in touched})
            rows = batch if before is None else batch.unionByName(before)
            ties = [F.col(ts), *([F.col(value).isNull()] if value else []), F.struct(*[F.col(c) for c in schema.names])]
            newest = rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in schema.names]), F.struct(*ties)).alias("r")).select("r.*")
            newest.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/{number}")
        finally:
            batch.unpersist()
        now = {**known, **{b: number for b in touched}}
        if now:
            spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/{number}")
        _tidy(spark, table, number, now, known)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def _tidy(spark: SparkSession, table: str, number: int, now: dict[int, int], known: dict[int, int]) -> None:
    """Remove what neither the new manifest nor the one before it names."""
    needed = {*now.items(), *known.items()}
    older = [n for n in complete(spark, f"{table}/manifest") if n < number]
    if len(older) > 1:
        for bucket, batch in _manifest(spark, table, older[-1]).items():
            if (bucket, batch) not in needed:
                _drop(spark, f"{table}/data/{batch}/bucket={bucket}")
        for n in older[:-1]:
            _drop(spark, f"{table}/manifest/{n}")


def open_upserted(spark: SparkSession, table: str, schema, value: str | None = None) -> DataFrame:
    """The rows that ``upsert_stream`` keeps, without deleted keys if ``value`` is given."""
    rows = _rows(spark, table, schema, _manifest(spark, table))
    rows = spark.createDataFrame([], schema) if rows is None else rows
    return rows.where(F.col(value).isNotNull()) if value else rows
