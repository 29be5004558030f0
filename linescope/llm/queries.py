"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.llm import additive, cover_tree, divergence, line_dedup, mixing, orc_ids, packing, periods, pii, quality, secrets, simhash, substrings
from linescope.llm.common import Scratch, table
from linescope.llm.oracles import ORACLE_SQL as ORACLE_SQL

#: The key of the registered query's pseudonyms. Whoever runs the operator passes a secret of their own.
KEY = "linescope registered query"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return done.select("doc_id", "text", *[f"n_{k}" for k in pii.PATTERNS])


def op5_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return additive.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "size", "source_size", "target", "taken", "position"]
    return mixing.schedule(table(spark, sf_dir, "documents")).select(*columns).orderBy("position", "doc_id")


def op7_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, location = table(spark, sf_dir, "documents"), Scratch(spark).path("ids")
    orc_ids.write_ids(docs, location)
    return orc_ids.digests(orc_ids.read_ids(spark, location, kind=docs.schema["doc_id"].dataType))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.without_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.planted_runs(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_additive": op5_additive,
    "op6_mixing": op6_mixing,
    "op7_orc_ids": op7_orc_ids,
    "op8_substrings": op8_substrings,
    "op9_cover_tree": op9_cover_tree,
    "op10_secrets": op10_secrets,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_divergence": op13_divergence,
}
