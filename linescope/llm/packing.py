"""Best-fit packing of documents into sequences by a grouping genetic algorithm on distributed islands.

A longer document is cut into full pieces and one shorter first piece; full pieces are sequences of their own. The
shorter ones are dealt into blocks of bounded size. For every block several islands evolve groupings: a crossover
injects whole well-filled bins of one parent into the other; bins that hold an injected piece a second time are
dissolved, and so are a few of the emptiest (mutation); displaced pieces are placed by best fit, longest first. Each
child is polished by local search. An island's epoch ends when it meets the lower bound or when ``STILL`` children in a
row have not saved a bin. Between epochs the elites of each island migrate to the next one; a block whose epoch has not
saved a bin rests. Pieces in bins that stay clearly below the limit are dealt again into
fewer blocks with those of other blocks, until all bins together meet the lower bound, one block is left, or two levels
in a row have each saved fewer than one bin in a thousand.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linescope.llm import tokens
from linescope.llm.common import Scratch

Solution = np.ndarray  # the bin of each piece, bins numbered from 0

#: Groupings of an island, and children without a better one after which it rests.
PEOPLE, STILL = 4, 12
#: Bins that a child's local search dissolves: as many of the emptiest at most, and as many others.
SPARE = 16


def lower_bound(sizes: np.ndarray, limit: int) -> int:
    """Bins that any packing of ``sizes`` needs."""
    return counted_bound(np.bincount(sizes, minlength=limit + 1), limit)


def counted_bound(counts: np.ndarray, limit: int) -> int:
    """``lower_bound`` of ``counts[s]`` pieces of each size s.

    Total size, and for each k the pieces over limit - k beside those over limit / 2.
    """
    number, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * np.arange(limit + 1))))
    best = -(-int(total[-1]) // limit)
    half = limit // 2
    for k in range(half + 1):
        alone = number[-1] - number[limit - k + 1]
        pairs = number[limit - k + 1] - number[half + 1]
        room = pairs * limit - (total[limit - k + 1] - total[half + 1])
        rest = total[half + 1] - total[k]
        best = max(best, int(alone + pairs + max(0, -(-int(rest - room) // limit))))
    return best


def best_fit(sizes: np.ndarray, order: np.ndarray, limit: int, fills: list[int], solution: Solution) -> None:
    """Place the pieces of ``order`` one by one into the bin they leave fullest, opening bins as needed, in place."""
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has r tokens of room
    for b, fill in enumerate(fills):
        if (room := limit - fill) > 0:
            open_bins.setdefault(room, []).append(b)
            rooms |= 1 << room
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bins = open_bins[room]
            b = bins.pop()
            if not bins:
                rooms ^= 1 << room
                del open_bins[room]
        else:
            b, room = len(fills), limit
            fills.append(0)
        solution[i] = b
        fills[b] += size
        if room := room - size:
            open_bins.setdefault(room, []).append(b)
            rooms |= 1 << room


def rank(sizes: np.ndarray, solution: Solution, limit: int) -> tuple[int, float]:
    """Smaller is better: bins, then fewer well-filled ones."""
    fills = np.bincount(solution, sizes)
    return len(fills), -float(((fills / limit) ** 2).sum())


def polished(sizes: np.ndarray, child: Solution, limit: int, spare: int, rng: np.random.Generator) -> Solution:
    """Local search: the ``spare`` emptiest bins and some others with room are dissolved, their pieces traded.

    A trade puts a piece in the place of a smaller one where it fills a bin best, so that what is displaced shrinks and
    takes up the room that is scattered over the other bins; the rest is placed by best fit.
    """
    fills = np.bincount(child, sizes).astype(np.int64)
    dissolved, order = np.zeros(len(fills), bool), np.argsort(fills, kind="stable")
    dissolved[order[:spare]] = True
    order = order[spare:][fills[order[spare:]] < limit]
    dissolved[rng.permutation(order)[:SPARE]] = True
    child, displaced = child.copy(), dissolved[child]
    inside = np.flatnonzero(~displaced & (fills[child] < limit))
    held, bins = sizes[inside], child[inside]
    rooms, todo = limit - fills[bins], np.flatnonzero(displaced).tolist()
    fills[dissolved], rest = limit, []
    while todo and len(inside):
        i = todo.pop()
        gain = sizes[i] - held
        gain[gain > rooms] = 0
        at = int(gain.argmax())
        if (won := int(gain[at])) <= 0:
            rest.append(i)
            continue
        b, freed = bins[at], int(inside[at])
        child[i], inside[at], held[at] = b, i, sizes[i]
        rooms[bins == b] -= won
        fills[b] += won
        todo.append(freed)
    order = np.array([*todo, *rest], np.int64)
    left = fills.tolist()
    best_fit(sizes, order[np.argsort(-sizes[order], kind="stable")], limit, left, child)
    return np.unique(child, return_inverse=True)[1]


def crossover(sizes: np.ndarray, donor: Solution, other: Solution, limit: int, rng: np.random.Generator) -> Solution:
    """A child of ``other`` with whole well-filled bins of ``donor``."""
    fills = np.bincount(donor, sizes)
    floor = np.quantile(fills, rng.uniform(0.1, 0.6))
    chosen = (fills >= min(floor, limit)) & (rng.random(len(fills)) < rng.choice((0.05, 0.1, 0.3)))
    injected = chosen[donor]
    theirs = np.bincount(other, sizes)
    broken = np.zeros(len(theirs), bool)
    broken[other[injected]] = True
    emptiest = np.argsort(theirs + rng.random(len(theirs)), kind="stable")
    broken[emptiest[: 1 + int(rng.integers(0, max(2, len(theirs) // 50)))]] = True
    kept = ~broken[other] & ~injected
    child = np.full(len(sizes), -1, np.int64)
    child[injected] = (np.cumsum(chosen) - 1)[donor[injected]]
    n = int(chosen.sum())
    child[kept] = n + (np.cumsum(~broken) - 1)[other[kept]]
    inside = child >= 0
    new_fills = np.bincount(child[inside], sizes[inside], minlength=n + int((~broken).sum())).astype(int).tolist()
    displaced = np.flatnonzero(~inside)
    order = displaced[np.argsort(-sizes[displaced] - rng.random(len(displaced)), kind="stable")]
    best_fit(sizes, order, limit, new_fills, child)
    return np.unique(child, return_inverse=True)[1]


def first_solution(sizes: np.ndarray, limit: int, jitter: float, rng: np.random.Generator) -> Solution:
    keys = -sizes * (1 + jitter * rng.random(len(sizes))) if jitter else -sizes
    solution = np.zeros(len(sizes), np.int64)
    best_fit(sizes, np.argsort(keys, kind="stable"), limit, [], solution)
    return solution


def evolve(sizes: np.ndarray, elites: list[Solution], limit: int, seed, people: int = PEOPLE, still: int = STILL) -> tuple[list[Solution], int]:
    """The two best groupings of one island after an epoch, and the bins of the best one it began with.

    It begins with ``elites``, or with best fit of falling sizes, and with best fit of sizes in a disturbed order.
    """
    rng, least = np.random.default_rng(seed), lower_bound(sizes, limit)
    group = list(elites) or [first_solution(sizes, limit, 0.0, rng)]
    while len(group) < people and int(group[0].max()) + 1 > least:
        group.append(first_solution(sizes, limit, rng.uniform(0, 0.3), rng))
    scored = sorted(((rank(sizes, s, limit), k, s) for k, s in enumerate(group)), key=lambda x: x[:2])
    idle, born, began = 0, len(group), scored[0][0][0]
    while scored[0][0][0] > least and idle < still:
        parents = [min(rng.integers(0, len(scored), 2)) for _ in range(2)]
        child = crossover(sizes, scored[parents[0]][2], scored[parents[1]][2], limit, rng)
        child = polished(sizes, child, limit, max(1, min(SPARE, int(child.max()) + 1 - least)), rng)
        found = rank(sizes, child, limit)
        idle, born = 0 if found[0] < scored[0][0][0] else idle + 1, born + 1
        if all(found != r for r, _, _ in scored):
            scored = sorted([*scored, (found, born, child)], key=lambda x: x[:2])[:people]
    return [s for _, _, s in scored[:2]], began


def pieces(docs: DataFrame, vocabulary: str, limit: int, end_id: int, key: str, text: str) -> DataFrame:
    """``(uid, key, piece, start, length, ids_crc32)``; uid is unique in one evaluation."""
    kind = docs.schema[key].dataType
    names = ["uid", key, "piece", "start", "length", "ids_crc32"]
    types = [T.LongType(), kind, T.IntegerType(), T.LongType(), T.LongType(), T.LongType()]

    def cut(batches):
        uid, encoder = TaskContext.get().partitionId() << 40, tokens.encoder(vocabulary)
        for b in (s for batch in tokens.tidied(batches, encoder.pieces) for s in tokens.slices(batch, 1)):
            ids, bounds = encoder.encode(b.column(1))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(b.num_rows + 1)
            rows: list[tuple] = []
            for doc, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                first = (e - s) % limit or limit
                cuts = [s, *range(s + first, e + 1, limit)]
                rows += [(doc, k, x - s, y - x, zlib.crc32(ids[x:y])) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
            doc, *rest = zip(*rows)
            columns = [pa.array(np.arange(uid, uid + len(rows))), b.column(0).take(pa.array(doc)), pa.array(rest[0], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in rest[1:])], names=names)
            uid += len(rows)

    return docs.select(key, text).mapInArrow(cut, T.StructType([T.StructField(*f) for f in zip(names, types)]))


def pack(
    docs: DataFrame,
    limit: int = 1024,
    end_id: int = 2,
    vocabulary: str | None = None,
    block: int = 16_384,
    islands: int = 3,
    epochs: int = 4,
    slack: int = 2,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every piece of every document with its place: ``(key, piece, start, length, ids_crc32, sequence_id, offset)``.

    A document is its text's ids and ``end_id``; null and empty texts are ``end_id`` alone. Only documents of more than
    ``limit`` ids are cut, the first piece being the shorter one. Rows are packed one by one: repeated rows and rows
    without a key are documents of their own. ``block`` bounds the pieces an island holds; bins with at most ``slack``
    ids of room are not dealt again. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.write(pieces(docs, vocabulary or tokens.default_vocabulary(), limit, end_id, key, text), "pieces")
    whole = cut.where(F.col("length") == limit).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = cut.where(F.col("length") < limit).select("uid", "length")
    places, level, open_bins, idle = [whole], 0, None, 0
    while True:
        counts = np.zeros(limit + 1, np.int64)
        for size, n in left.groupBy("length").count().collect():  # fewer than ``limit`` rows
            counts[size] = n
        number = int(counts.sum())
        if not number:
            break
        blocks, least = -(-number // block), counted_bound(counts, limit)
        dealt = left.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("items")
        )
        dealt = dealt.select("block", F.col("items.length").alias("sizes"), F.col("items.uid").alias("uids"))
        best = _evolved(scratch, scratch.write(dealt, f"blocks-{level}"), islands, epochs, limit, level)
        placed = scratch.write(_places(best, limit, level), f"places-{level}")
        free = F.col("room") > slack
        first = (F.col("offset") == 0).cast("long")
        bins, loose = placed.agg(F.sum(first), F.coalesce(F.sum(F.when(free, first)), F.lit(0))).first()
        idle = idle + 1 if open_bins and open_bins - bins < open_bins / 1000 else 0
        last = blocks == 1 or bins <= least or not loose or idle == 2
        places.append((placed if last else placed.where(~free)).select("uid", "sequence_id", "offset"))
        if last:
            break
        left, open_bins, level = placed.where(free).select("uid", "length"), loose, level + 1
    found = places[0]
    for more in places[1:]:
        found = found.union(more)
    return cut.join(found, "uid").select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _evolved(scratch: Scratch, blocks: DataFrame, islands: int, epochs: int, limit: int, level: int) -> DataFrame:
    """The best grouping of each block, ``(block, sizes, uids, elites)``."""
    schema = "block long, island int, bins int, began int, least int, elites array<array<int>>"
    arrow = pa.schema([("block", pa.int64()), *((n, pa.int32()) for n in ("island", "bins", "began", "least")), ("elites", pa.list_(pa.list_(pa.int32())))])

    def epoch(number: int):
        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    sizes = np.array(row["sizes"], np.int64)
                    elites = [np.array(e, np.int64) for e in row["elites"] or []]
                    seed = (level, number, row["block"], row["island"])
                    found, began = evolve(sizes, elites, limit, np.random.SeedSequence(seed))
                    out = {"block": row["block"], "island": row["island"], "bins": int(found[0].max()) + 1, "began": began}
                    out |= {"least": lower_bound(sizes, limit), "elites": [e.tolist() for e in found]}
                    yield pa.RecordBatch.from_pylist([out], schema=arrow)

        return run

    count = max(1, blocks.count() * islands)
    spread = blocks.select("block", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = None
    for number in range(epochs):
        if state is None:
            given = spread.withColumn("elites", F.lit(None).cast("array<array<int>>"))
        else:
            # an island starts from its own elites and those of the island before it; the other blocks rest
            open_ = state.join(_moving(state).select("block"), "block")
            moved = open_.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elites").alias("migrants"))
            given = open_.join(moved, ["block", "island"]).join(spread, ["block", "island"])
            given = given.select("block", "sizes", "island", F.concat("elites", "migrants").alias("elites"))
        dealt = given.select("block", "island", "sizes", "elites").repartition(min(count, 4096), "block", "island")
        fresh = scratch.write(dealt.mapInArrow(epoch(number), schema), f"state-{level}-{number}")
        if state is None:
            state = fresh
        else:
            resting = state.join(fresh.select("block").distinct(), "block", "left_anti")
            state = scratch.write(resting.union(fresh), f"joined-{level}-{number}")
        if _moving(state).isEmpty():
            break
    chosen = state.groupBy("block").agg(F.min_by("elites", F.struct("bins", "island")).alias("elites"))
    return blocks.join(chosen, "block")


def _moving(state: DataFrame) -> DataFrame:
    """Blocks above their lower bound whose last epoch has saved a bin."""
    best = state.groupBy("block").agg(*[f(c).alias(c) for f, c in ((F.min, "bins"), (F.min, "began"), (F.max, "least"))])
    return best.where("bins > least and bins < began")


def _places(best: DataFrame, limit: int, level: int) -> DataFrame:
    """``(uid, length, sequence_id, offset, room)`` of each piece."""
    schema = "uid long, length long, sequence_id long, offset long, room long"

    def place(batches):
        for b in batches:
            for row in b.to_pylist():
                sizes, uids = np.array(row["sizes"], np.int64), np.array(row["uids"], np.int64)
                bins = np.array(row["elites"][0], np.int64)
                order = np.argsort(bins, kind="stable")
                s, g = sizes[order], bins[order]
                before = np.cumsum(s) - s
                opens = np.searchsorted(g, g)
                room = limit - np.bincount(g, s).astype(np.int64)[g]
                sequence = (level << 56) + (row["block"] << 24) + g
                columns = (uids[order], s, sequence, before - before[opens], room)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "length", "sequence_id", "offset", "room"])

    return best.select("block", "sizes", "uids", "elites").mapInArrow(place, schema)
