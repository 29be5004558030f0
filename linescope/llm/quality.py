"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed: its words, and the 4-grams of its sequence of character classes (lower case, upper case,
digit, blank, line end, each other sign; runs count once), plus two terms for words that follow themselves. Weighted by
inverse document frequency and projected on the leading singular directions of a bounded labelled sample, texts become
short vectors. The sample's vectors are broadcast (at most ``LABELLED`` rows of ``RANK`` floats); every document's exact
cosines with all of them are computed in blocks, and its nearest neighbours' labels are averaged by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linescope.llm import tokens
from linescope.llm.common import unused

#: Labelled rows that a model may hold (half for each label), latent dimensions, neighbours that vote.
LABELLED, RANK, NEIGHBOURS = 4096, 48, 15
#: Hashed terms: half for words, half for classes of characters.
TERMS = 2048
#: Rows for which counts are held at once, and bytes of text, for each of which the counting holds some hundred more.
ROWS, FEW = 256, 1 << 18
#: Power of the cosine in a vote, and votes of the prior, which decide where nothing is similar.
SHARPNESS, PRIOR_VOTES = 4, 0.01

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.int64)
    table[[c for c in range(256) if chr(c).islower() or c >= 128]] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[[9, 11, 12, 13, 32]] = ord(" ")
    return table


_CLASS = _classes()
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_PLACE = np.random.default_rng(7).integers(1, 1 << 63, 64, np.int64).astype(np.uint64) | np.uint64(1)


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed terms, one row for each text (float32)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # each text ends with a line end
    doc = np.repeat(np.arange(len(texts)), sizes)
    half, keys = TERMS // 2, []
    # character classes
    kinds = _CLASS[data]
    changed = np.concatenate(([True], (kinds[1:] != kinds[:-1]) | (doc[1:] != doc[:-1])))
    k, d = kinds[changed], doc[changed]
    if len(k) > 3:
        grams = ((k[:-3] * 131 + k[1:-2]) * 131 + k[2:-1]) * 131 + k[3:]
        same = d[:-3] == d[3:]
        keys.append(d[:-3][same] * TERMS + half + (grams[same] * 2654435761 >> 12) % half)
    # words
    inside = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
        if place is None:
            lead = starts[0]
            place = np.concatenate((np.zeros(lead, np.int64), np.arange(lead, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))))
        mixed = np.where(inside, _LOWER[data] * _PLACE[place & 63], np.uint64(0))
        words, owner = np.add.reduceat(mixed, starts), doc[starts]
        keys.append(owner * TERMS + 2 + ((words >> np.uint64(17)) % np.uint64(half - 2)).astype(np.int64))
        again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        keys.append(owner[1:][again] * TERMS)
        thrice = again[1:] & again[:-1]
        keys.append(owner[2:][thrice] * TERMS + 1)
    counts = np.bincount(np.concatenate(keys), minlength=len(texts) * TERMS) if keys else np.zeros(len(texts) * TERMS)
    return counts.reshape(len(texts), TERMS).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of terms
    directions: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # of the labelled texts, unit length
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts) * self.weights) @ self.directions)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest and the prior, which is all where nothing is similar."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        found = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, found.shape[1])
        near = np.argpartition(found, -k, axis=1)[:, -k:]
        votes = np.maximum(np.take_along_axis(found, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        return ((votes * self.labels[near]).sum(axis=1) + PRIOR_VOTES * self.prior) / (votes.sum(axis=1) + PRIOR_VOTES)


def _fit(counts: np.ndarray, labels: np.ndarray, prior: float) -> Model:
    logs = np.log1p(counts)
    weights = np.log((1 + len(logs)) / (1 + (logs > 0).sum(axis=0))).astype(np.float32) + np.float32(0.05)
    x = _unit(logs * weights)
    rng = np.random.default_rng(11)
    q = np.linalg.qr(x @ rng.standard_normal((TERMS, RANK + 16), np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    directions = np.ascontiguousarray(np.linalg.svd(q.T @ x, full_matrices=False)[2][:RANK].T)
    return Model(weights, directions, _unit(x @ directions), labels, prior)


def _blocks(batch: pa.RecordBatch, column: int):
    for part in tokens.slices(batch, column, FEW):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def held_out(key: Column) -> Column:
    """The fold that is never learnt from: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """A model of ``labels(key, label)`` outside the held-out fold.

    Of each label at most ``LABELLED // 2`` keys are taken, by a hash of the key. Rows with a null key or label are
    ignored; a key with several labels has their mean, and with several texts the smallest. The prior is the mean label
    of all rows outside the fold, 0.5 without any.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(key).agg(F.avg(label).alias("label"))
    prior = known.agg(F.avg("label")).first()[0]
    picked = None
    for side in (F.col("label") < 0.5, F.col("label") >= 0.5):
        some = known.where(side).orderBy(F.xxhash64(key), key).limit(LABELLED // 2)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(key, text).join(F.broadcast(picked), key).groupBy(key, "label").agg(F.min(text).alias("text"))

    def count(batches):
        for b in (s for batch in batches for s in _blocks(batch, 1)):
            rows = [c.tobytes() for c in term_counts(_bytes(b.column(1))).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["label", "counts"])

    found = texts.orderBy(key).select("label", "text").mapInArrow(count, "label double, counts binary").toPandas()
    if found.empty:
        empty = np.zeros((0, RANK), np.float32)
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, RANK), np.float32), empty, np.zeros(0), 0.5 if prior is None else prior)
    counts = np.stack([np.frombuffer(c, np.float16) for c in found["counts"]]).astype(np.float32)
    return _fit(np.minimum(counts, 60_000), found["label"].to_numpy(np.float64), prior)


def rated(model: Model, texts: pa.Array) -> pa.Array:
    """The texts' scores, taken over a bounded part of them at once."""
    counts = (term_counts(_bytes(b.column(0))) for b in _blocks(pa.RecordBatch.from_arrays([texts], names=["text"]), 0))
    parts = [np.clip(model.score(np.minimum(c, 60_000)), 0, 1) for c in counts]
    return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``(key, *keep, name)`` for every row, ``name`` holding its score; null and empty texts get the model's prior.

    Only texts go to Python, and only scores come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tokens.tidied(batches):
            yield rated(shared.value, texts)

    return docs.select(key, *keep, rate(F.col(text)).alias(name))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(key, held_out, score, predicted)``; predicted is 1 from ``threshold`` on."""
    rated = score(docs, fit(docs, labels, key=key, text=text), key, text)
    return rated.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (with all their columns) that score ``threshold`` or more."""
    others, name = tuple(c for c in docs.columns if c != "doc_id"), unused("__score", docs.columns)
    return score(docs, fit(docs, labels), keep=others, name=name).where(F.col(name) >= threshold).select(*docs.columns)
