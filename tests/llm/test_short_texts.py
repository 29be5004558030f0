"""Short texts in the near-duplicate stage: every pair of a similarity of 0.8 or more is found."""

import random

import numpy as np
import pytest

pytest.importorskip("linescope.llm")
from linescope.llm import additive, simhash  # noqa: E402
from test_brute import groups, plain_shingles, similar_groups  # noqa: E402


def texts_of(rng, n, shingles):
    """``n`` pairs of texts that differ at one end by as many words as a similarity of 0.8 allows, and texts of the same words."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(n):
        body = [word() for _ in range(shingles + 4)]
        cut = int(shingles * 0.2)
        out += [body, body[: len(body) - cut] if rng.random() < 0.5 else [word() for _ in range(cut // 2)] + body[cut // 2 :]]
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("shingles", [1, 5, 10, 14, 15, 17])
def test_recall_of_short_pairs(spark, shingles):
    texts = texts_of(random.Random(shingles), 150, shingles)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(similar_groups(dict(enumerate(texts))).values())
    got = {r["doc_id"] for r in simhash.keep_one(rows).collect()}
    lost = len(got - want)
    assert want <= got and lost <= (0 if shingles <= simhash.SHORT else 0.02 * (len(texts) - len(want)))


def test_short_crowds(spark):
    """Texts that share a template and differ by a word or two: all components, with few pairs a text."""
    rng = random.Random(2)
    base = [f"template{i}" for i in range(14)]
    texts = list(dict.fromkeys(" ".join([*base, *(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(rng.randrange(1, 4)))]) for _ in range(600)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = similar_groups(dict(enumerate(texts)))
    assert {r["doc_id"] for r in simhash.keep_one(rows).collect()} == set(want.values())


def test_common_subsets():
    rng = random.Random(1)
    for _ in range(200):
        pool = np.array([rng.getrandbits(64) for _ in range(20)], np.uint64)
        a = set(rng.sample(range(20), rng.randrange(1, 18)))
        b = (a - set(rng.sample(sorted(a), min(len(a), rng.randrange(3))))) | set(rng.sample(range(20), rng.randrange(3)))
        x, y = (set(simhash.common_subsets(pool[sorted(s)], 0.8).tolist()) for s in (a, b))
        if b and len(a & b) >= 0.8 * len(a | b) and min(len(a), len(b)) <= simhash.SHORT:
            assert x & y
    assert groups([1, 2], [(1, 2)]) == {1: 1, 2: 1} and plain_shingles("a") == {"a"}


def test_a_vector_that_most_rows_have(spark):
    """Its rows are cut to k + 1 before the shuffle, and the nearest are exact, ties by key."""
    rng = np.random.default_rng(5)
    own = rng.normal(size=(40, 6)).round(3)
    data = [(i, (own[i // 10] if i % 10 == 0 else own[0]).tolist()) for i in range(400)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(6)
    asked = rows.where("vec_id % 40 = 0")
    plans = []
    write = additive.Scratch.write

    def seen(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name)

    additive.Scratch.write = seen
    try:
        got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in additive.nearest(rows, asked, k=5).collect())
    finally:
        additive.Scratch.write = write
    assert "Partial" in next(p for p in plans if "WindowGroupLimit" in p)
    want = []
    for i, v in data[::40]:
        ranked = sorted((np.linalg.norm(np.array(v) - w), j) for j, w in data if j != i)[:5]
        want += [(i, n, j) for n, (_, j) in enumerate(ranked, 1)]
    assert got == sorted(want)
