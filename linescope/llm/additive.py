"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one of each codebook. Codebooks are fitted on a
bounded sample: k-means on residuals, then codes by beam search and all codewords together by least squares. Every vector
is encoded by beam search and stored as its codes and the squared norm of its approximation. A query's squared distance
to an approximation is that norm minus twice a sum of table entries, the query's inner products with the codewords. The
best candidates by tables are ranked again by exact distances of the original vectors; their number grows with the
square root of the table, as the nearest vectors of a larger table are closer to each other.

Queries are a stated set; they are compared with all rows in blocks of bounded size, which are broadcast one by one. What
a query's candidates must stay below is first read off a bounded sample of the index, so that tasks return little more
than the candidates, however many parts the index has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linescope.llm.common import Scratch
from linescope.llm.cover_tree import valid

#: Rows of the sample, codebooks, codewords in each, partial codes kept by the beam search.
SAMPLE, BOOKS, WORDS, BEAM = 8192, 24, 128, 4
#: Candidates ranked again for each query at least, and for each root of the number of rows.
RERANKED, BY_ROOT = 900, 4
#: Bytes of a block of queries, rows of the index in a part at most and about at least.
QUERIES, PART, SMALL = 32 << 20, 131_072, 4096


@dataclass(frozen=True)
class Quantiser:
    words: np.ndarray  # BOOKS x WORDS x dimensions, single precision

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) and the squared norms of their sums."""
        books, size, dims = self.words.shape
        flat = self.words.reshape(-1, dims)
        gram, inner = flat @ flat.T, x @ flat.T
        own = np.einsum("ij,ij->i", flat, flat)
        n = len(x)
        codes, score = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for m in range(books):
            at = slice(m * size, (m + 1) * size)
            cost = score[:, :, None] + (own[at] - 2 * inner[:, at])[:, None, :]
            for j in range(m):
                cost += 2 * gram[codes[:, :, j] + j * size, at]
            width = min(beam, cost.shape[1] * size)
            cost = cost.reshape(n, -1)
            best = np.argpartition(cost, width - 1, axis=1)[:, :width]
            score = np.take_along_axis(cost, best, axis=1)
            codes = np.concatenate((np.take_along_axis(codes, (best // size)[:, :, None], axis=1), (best % size)[:, :, None]), axis=2)
        codes = codes[np.arange(n), score.argmin(axis=1)]
        return codes.astype(np.uint8), (self.decode(codes) ** 2).sum(axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products, queries x BOOKS x WORDS."""
        books, size, dims = self.words.shape
        return (queries.astype(np.float32) @ self.words.reshape(-1, dims).T).reshape(len(queries), books, size)


def fit(sample: np.ndarray, books: int = BOOKS, size: int = WORDS, rounds: int = 1) -> Quantiser:
    rng, x = np.random.default_rng(17), sample.astype(np.float32)
    size = min(size, len(x))
    rest, words = x.copy(), []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), size, replace=False)].copy()
        for _ in range(5):
            near = ((centres**2).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
            counts = np.bincount(near, minlength=size)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        near = ((centres**2).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
        rest -= centres[near]
        words.append(centres)
    found = Quantiser(np.array(words, np.float32))
    for _ in range(rounds):
        codes = np.concatenate([found.encode(x[at : at + 1024])[0] for at in range(0, len(x), 1024)]).astype(np.int64)
        slots, total = codes + np.arange(books) * size, books * size
        pairs = (slots[:, :, None] * total + slots[:, None, :]).ravel()
        normal = np.bincount(pairs, minlength=total * total).reshape(total, total).astype(np.float64)
        right = np.zeros((total, x.shape[1]))
        for m in range(books):
            np.add.at(right, slots[:, m], x)
        normal[np.diag_indices(total)] += 0.5
        base = found.words.reshape(total, -1).astype(np.float64)
        solved = np.linalg.solve(normal, right + 0.5 * base)
        found = Quantiser(solved.reshape(found.words.shape).astype(np.float32))
    return found


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, reranked: int | None = None, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each row of ``queries`` its ``k`` nearest rows of ``vectors``: ``(query_id, rank, key, score)``.

    ``score`` is the Euclidean distance of the original vectors in double precision; ranks count from 1, ties go to the
    smaller key, and a row with the query's own key is no neighbour of it. Vectors that are null, zero or hold null or
    non-finite components, and rows without a key, take no part on either side; only vectors of one length are
    compared. Fewer than ``k`` others give fewer rows. Keys should be unique; repeated query keys are one query.

    Equal vectors are indexed once with their ``k + 1`` smallest keys, which are all that can be among the nearest.
    ``reranked`` candidates are ranked again, by default the larger of ``RERANKED`` and ``BY_ROOT`` times the root of the
    number of rows.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = valid(vectors, key, vector).where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "v")
    # the limit is applied before the shuffle too, so a vector that most rows have comes with k + 1 of them from each task
    turn = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = rows.withColumn("turn", turn).where(F.col("turn") <= k + 1).withColumn("class", F.min("id").over(Window.partitionBy("v")))
    kept = scratch.write(kept.withColumn("dims", F.size("v")), "kept")
    asked = valid(queries, key, vector).where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("query_id")).agg(F.min("v").alias("q"))
    asked = scratch.write(asked.withColumn("dims", F.size("q")), "asked")
    out = None
    for dims in sorted(r[0] for r in asked.select("dims").distinct().collect()):
        some = F.col("dims") == dims
        found = _search(scratch, kept.where(some), asked.where(some), dims, k, reranked)
        out = found if out is None else out.union(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    return out.withColumnRenamed("id", key)


def _floats(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    return (column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.float32).reshape(-1, dims)


def _scale(vectors: DataFrame) -> float:
    """The power of two that brings the largest component to about 1, so that single precision can hold them all."""
    most = vectors.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0]
    return float(2.0 ** -np.frexp(most)[1])


def _search(scratch: Scratch, kept: DataFrame, asked: DataFrame, dims: int, k: int, reranked: int | None) -> DataFrame:
    spark, tag = scratch.spark, f"-{dims}"
    classes = kept.where("turn = 1").select("class", "v")
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).toPandas()["v"]
    if sample.empty:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    scale = _scale(kept)
    units = np.array([np.asarray(v, np.float64) * scale for v in sample])
    model = spark.sparkContext.broadcast(fit(units))

    def encode(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                codes, norms = model.value.encode(_floats(part.column(1), dims, scale))
                columns = [part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32))]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "codes", "norm"])

    index = scratch.write(classes.mapInArrow(encode, "class long, codes binary, norm float"), "index" + tag)
    number = index.count()
    reranked = reranked or max(RERANKED, int(BY_ROOT * number**0.5))
    parts = max(-(-number // PART), min(spark.sparkContext.defaultParallelism, -(-number // SMALL)))
    index = index.repartition(parts)
    codes, norms = model.value.encode(units.astype(np.float32))
    blocks = -(-asked.count() * 8 * dims // QUERIES)
    candidates = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "q")
        rows = mine.orderBy("query_id").toPandas()  # a block, about QUERIES bytes
        q = np.array([np.asarray(v, np.float64) * scale for v in rows["q"]], np.float32)
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), q, _limits(model.value, q, codes, norms, number, reranked)))
        found = scratch.write(_candidates(index, shared, model), f"candidates{tag}-{block}")
        candidates = found if candidates is None else candidates.union(found)
    best = Window.partitionBy("query_id").orderBy("score", "class")
    pairs = candidates.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("guess", "class"))).where(F.col("turn") <= reranked)
    pairs = pairs.select("query_id", "class").join(classes, "class").join(asked.select("query_id", "q"), "query_id")
    square = F.zip_with("q", "v", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    pairs = pairs.select("query_id", "class", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    pairs = pairs.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= k + 1).drop("turn")
    rows = pairs.join(kept.select("class", "id"), "class").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return rows.select("query_id", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)


def guesses(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Squared distances to approximations without the queries' own norms, queries x rows."""
    dot = np.zeros((len(tables), len(codes)), np.float32)
    for m in range(codes.shape[1]):
        dot += np.take(tables[:, m], codes[:, m], axis=1)
    return norms - 2 * dot


def _limits(model: Quantiser, q: np.ndarray, codes: np.ndarray, norms: np.ndarray, number: int, reranked: int) -> np.ndarray:
    """For each query what at least ``reranked`` of ``number`` rows stay below, by a sample: three deviations above."""
    share = reranked * len(codes) / number
    place = int(share + 3 * share**0.5 + 3)
    if place >= len(codes) or len(codes) == number:
        return np.full(len(q), np.inf, np.float32)
    out = [np.partition(guesses(model.tables(q[a : a + 256]), codes, norms), place, axis=1)[:, place] for a in range(0, len(q), 256)]
    return np.concatenate(out)


def _candidates(index: DataFrame, shared, model) -> DataFrame:
    """The rows of the index below the queries' limits: ``(query_id, class, guess)``."""

    def scan(batches):
        held = [b for b in batches if b.num_rows]  # a part, at most about ``PART`` codes
        if not held:
            return
        classes, norms = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 2))
        codes = np.frombuffer(b"".join(x for b in held for x in b.column(1).to_pylist()), np.uint8).reshape(len(classes), -1)
        ids, q, limits = shared.value
        for at in range(0, len(q), 256):
            tables = model.value.tables(q[at : at + 256])
            for begin in range(0, len(codes), 2048):
                guess = guesses(tables, codes[begin : begin + 2048], norms[begin : begin + 2048])
                i, j = np.nonzero(guess <= limits[at : at + 256, None])
                columns = [pa.array(ids[at + i]), pa.array(classes[begin + j]), pa.array(guess[i, j])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "class", "guess"])

    return index.mapInArrow(scan, "query_id long, class long, guess float")
