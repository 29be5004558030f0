"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import re
import shutil
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("linescope.llm")
from linescope.llm import additive, cover_tree, mixing, orc_ids, packing, pii, quality, secrets, simhash, substrings, tokens  # noqa: E402
from linescope.llm.common import Scratch  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, fp string, component_id long, part int, id long, v string"
LONG = "Word after word, " * 20_000


def rows(*texts, first=0):
    return [(i, t, None, None if i % 2 else "s", None, -1, 0.5, "x", 7, 1, 2, "y") for i, t in enumerate(texts, first)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "   ", "one", "one", "A b c d e f", "a b c d e f", LONG, LONG, "4111111111111111 x", "a" * 5000]
    data = rows(*texts) + rows("one", first=3) + [(None, *r[1:]) for r in rows("one", None, "Q r s")]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None), (99, 1)], "doc_id long, quality int")


OPERATORS = {
    "simhash": lambda d, labels: simhash.near_duplicates(d),
    "quality": lambda d, labels: quality.classify(d, labels),
    "pii": lambda d, labels: pii.pseudonymise(d, "k"),
    "mixing": lambda d, labels: mixing.schedule(d),
    "secrets": lambda d, labels: secrets.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, docs, none, labels):
    out = OPERATORS[name](docs, labels)
    assert out.count() == docs.count()
    assert sorted(map(str, (r[0] for r in out.select("doc_id").collect()))) == sorted(map(str, (r[0] for r in docs.select("doc_id").collect())))
    assert OPERATORS[name](none, labels).count() == 0


def test_empty_labels(docs, labels):
    out = quality.classify(docs, labels.where("false"))
    assert {r["score"] for r in out.collect()} == {0.5}


def test_quality_keeps_columns(docs, labels):
    assert quality.keep_good(docs, labels, threshold=0.0).columns == docs.columns


def test_quality_sends_python_each_text_once(docs, labels):
    """No other column goes there, and no text comes back."""
    for out in (quality.keep_good(docs, labels), quality.classify(docs, labels)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("ArrowEvalPython [") == 1
        assert re.findall(r"ArrowEvalPython \[rate\((\w+)#", plan) == ["text"]


def test_quality_scores_in_little_memory():
    """Few arrays at once, over long and over short texts."""
    rng = np.random.default_rng(5)
    directions = np.linalg.qr(rng.standard_normal((quality.TERMS, quality.RANK)))[0].astype(np.float32)
    vectors = quality._unit(rng.standard_normal((quality.LABELLED, quality.RANK)).astype(np.float32))
    model = quality.Model(np.ones(quality.TERMS, np.float32), directions, vectors, rng.integers(0, 2, len(vectors)).astype(float), 0.5)
    for texts in (["Word after word, " * 200] * 1200, ["one two three four"] * 3000, []):
        texts = pa.array(texts, pa.string())
        tracemalloc.start()
        scores = quality.rated(model, texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(scores) == len(texts) and most < 32e6


def test_simhash_ties_and_null_keys(docs):
    out = {}
    for r in simhash.near_duplicates(docs).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert {r["fingerprint"] for i in (0, 1, 2) for r in out[i]} == {"0" * 16}
    assert {r["component_id"] for i in (0, 1, 2) for r in out[i]} == {0}
    assert [r["component_id"] for i in (3, 4) for r in out[i]] == [3, 3, 3]
    assert out[5][0]["fingerprint"] == out[6][0]["fingerprint"] and out[6][0]["component_id"] == 5
    assert sorted(str(r["component_id"]) for r in out[None]) == ["0", "3", "None"]


def test_simhash_keep_one(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "3", "5", "7", "9", "10", "None"])
    assert simhash.keep_one(none).count() == 0


def test_mixing_of_nulls(spark, docs):
    out = mixing.schedule(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert {r["doc_id"]: r["size"] for r in out}[7] == 60_000
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mix.collect()) == sum(r["taken"] for r in out)
    assert mixing.mixed(docs.where("text is null")).count() == 0


def test_packing(docs, none):
    out = packing.pack(docs).collect()
    check_packed(out)
    assert sum(r["piece"] == 0 for r in out) == docs.count()
    assert packing.pack(none).count() == 0


def check_packed(out, limit=1024):
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return bins


def test_orc(spark, docs, none):
    where = Scratch(spark).path("ids")
    orc_ids.write_ids(docs, where)
    out = orc_ids.digests(orc_ids.read_ids(spark, where)).collect()
    assert len(out) == docs.count()
    ordered = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:i]) for i in range(len(ordered))]
    known = [r["doc_id"] for r in ordered]
    assert known == sorted(known, key=lambda k: (k is not None, k or 0))
    orc_ids.write_ids(none, where + "-none")
    assert orc_ids.digests(orc_ids.read_ids(spark, where + "-none")).count() == 0


def test_substrings(docs, none):
    out = substrings.repeated_passages(docs)
    assert {(r["doc_id"], r["first_doc_id"]) for r in out.collect()} == {(7, 7), (8, 7)}
    cut = substrings.without_passages(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), out)
    assert cut.columns == docs.columns and cut.count() == 11
    assert substrings.repeated_passages(none).count() == 0


VECTORS = [
    (0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [0.0, 1.0], 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1),
    (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (200, None, 1), (300, [0.0, 1.0], 2),
]


def test_cover_tree(spark):
    vectors = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, id long")
    out = {r["vec_id"]: tuple(r)[1:] for r in cover_tree.near_vectors(vectors).collect()}
    assert len(out) == len(VECTORS)
    assert out[0] == (2, 0, True) and out[100] == (2, 0, False) and out[3] == (2, 0, False)
    assert out[4] == (1, 4, True) and out[300] == (1, 4, False)
    assert all(out[i] == (0, i, True) for i in (5, 6, 7, 8, 9, 10, 200))
    assert out[None] == (0, None, False)
    assert cover_tree.near_vectors(vectors.where("false")).count() == 0


def test_additive(spark):
    vectors = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, id long")
    out = additive.nearest(vectors.select("vec_id", "embedding"), vectors.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    root = 2**0.5
    assert found == {0: [(100, 0.0), (3, 1.0), (4, root), (300, root)], 100: [(0, 0.0), (3, 1.0), (4, root), (300, root)], 300: [(4, 0.0), (0, root), (100, root), (3, 5**0.5)]}
    assert additive.nearest(vectors.where("false"), vectors.where("false")).count() == 0
    assert additive.nearest(vectors, vectors.where("false")).count() == 0


def test_missing_shared_folder_is_an_error(spark, monkeypatch):
    from linescope.llm import common

    class Away:
        master, applicationId = "spark://far:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Away()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_hot_group_in_pii_counts(spark):
    out = pii.pseudonymise(spark.createDataFrame(rows("mail a.b@c.example.com now"), DOCS).withColumn("n_email", F.lit("clash")), "k").first()
    assert out["n_email"] == 1 and "a.b@c.example.com" not in out["text"]


CLASHING = ["_size", "_key", "_row", "_source", "_order", "_bucket", "_at", "_copy", "__score", "__text", "__done", "__key", "__turn", "__spans", "key", "node", "row", "own", "body", "turn", "n_email", "n_card", "shingles", "part", "leader"]


def test_pipeline_stages_on_odd_tables(spark, docs, none, labels, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    extra = docs.drop("part").withColumns({c: F.lit(77) for c in CLASHING})
    for table in (extra, extra.where("false")):
        rows, scratch = table, Scratch(spark)
        for name, stage in pipeline.STAGES[:-1]:
            rows = scratch.write(stage(spark, rows, str(tmp_path)), name)
            assert rows.columns == table.columns
        assert {r[c] for c in CLASHING for r in rows.select(*CLASHING).collect()} <= {77}
        assert (pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() > 0) == (rows.count() > 0)
    cut = substrings.without_passages(extra.where("doc_id is not null"), substrings.repeated_passages(extra))
    assert cut.columns == extra.columns


def test_packing_leaves_no_pieces_in_workers(spark, docs, tmp_path):
    """Workers are kept for the tasks of other operators; this vocabulary's encoder is this test's alone."""
    path = shutil.copy(tokens.default_vocabulary(), tmp_path / "vocabulary.json")
    assert packing.pieces(docs.repartition(4), str(path), 1024, 2, "doc_id", "text").count() > docs.count()

    def held(batches):
        for b in batches:
            pieces = tokens.encoder(str(path)).pieces
            yield pa.RecordBatch.from_arrays([pa.array([len(pieces.young) + len(pieces.old)])], names=["n"])

    assert {r["n"] for r in spark.range(0, 4, 1, 4).mapInArrow(held, "n long").collect()} == {0}
