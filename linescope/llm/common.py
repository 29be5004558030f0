"""What the operators of this subpackage share: tables in the shared folder, and readers of the given tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.sources.shared import shared_dir


class Scratch:
    """Parquet tables in the shared folder that cut a job's lineage; they survive lost executors.

    A table that the caller no longer needs goes with ``drop``; the rest goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

    def _close(self) -> None:
        try:
            self.drop()
        except Exception:  # the session has ended before; the folder is the cluster's to clear
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unused(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as make it no column's name; names differ in more than case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
