"""Exact pairs of near vectors by dual traversal of cover trees.

On unit vectors a cosine of c is a Euclidean distance of sqrt(2 - 2c), so triangle bounds hold. A cover tree has levels
of nodes whose reach halves from 2, which covers all unit vectors: the centres of a level are rows, those of the level
above among them; they lie further apart than its reach, and every row lies within its reach of one. A new centre hangs
below the nearest one of the level above, and a node's radius is measured over all rows beneath it.

Trees are built at two scales. The first levels come from bounded samples, at the root on the driver and for each cell of
it that holds more than a block in a task; every vector descends them to its nearest centre, so that the number of cells
grows with the table. Cells are split into blocks of bounded size, and each block gets a whole tree of its own. Pairs of
cells, then of blocks, are pruned by their radii. Each pair of blocks that is left is one task, which traverses both
trees level by level: pairs of nodes that are further apart than both radii and the threshold are pruned, pairs whose
rows all are near are taken as a whole, and rows of the last nodes are compared by exact cosines. A task returns one row
for each vector with a link (how many, and the smallest one it is connected to there), never the pairs themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linescope.llm.common import Scratch
from linescope.llm.components import connected_components

#: Rows of a sample for first levels, cells that one splits into, bytes of all centres at most, vectors in a block.
SAMPLE, FAN, CENTRES, BLOCK = 4096, 256, 32 << 20, 8192
#: Distances within this of a bound are not pruned, or taken as a whole, but looked at further.
MARGIN = 1e-3
#: Distances that are computed at once, pairs from which a node has a matrix of them, pairs that are gathered at once, and
#: links that are kept before their components are settled.
AT_ONCE, DENSE, GATHERED, HELD = 1 << 21, 1 << 12, 1 << 18, 1 << 21


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between unit rows of two single-precision matrices, to about 1e-6 from 0.1 on."""
    d = x @ y.T
    d *= -2
    d += 2
    return np.sqrt(np.maximum(d, 0, out=d), out=d)


def reaches(cosine: float) -> list[float]:
    """Reaches of the levels: halving from 2, down to a quarter of the threshold's distance."""
    out, least = [2.0], np.sqrt(max(0.0, 2 - 2 * cosine)) / 4
    while out[-1] / 2 >= max(least, 1e-3):
        out.append(out[-1] / 2)
    return out


def paths(u: np.ndarray, levels: list[float]) -> np.ndarray:
    """A cover tree over the rows of ``u`` (unit, single precision): for each row and level the row that is its centre.

    Rows are taken in order, in groups whose distances are computed at once. Column k is of the level of reach
    ``levels[k]``, and column k + 1 decides column k.
    """
    n = len(u)
    parents = np.zeros((len(levels), n), np.int64)  # of a centre of level k, in level k - 1
    owner, away = np.zeros(n, np.int64), distances(u, u[:1])[:, 0]
    is_centre = np.zeros(n, bool)
    is_centre[0], away[0] = True, 0
    for k, reach in enumerate(levels[1:], 1):
        above = owner.copy()  # the nearest centre of the level above
        while len(left := np.flatnonzero(away > reach)):
            group, fresh = left[:512], []
            own = distances(u[group], u[group])
            far = away[group].copy()
            for i, row in enumerate(group.tolist()):
                if far[i] > reach:
                    fresh.append(row)
                    np.minimum(far, own[i], out=far)
            fresh = np.array(fresh)
            is_centre[fresh], away[fresh], owner[fresh] = True, 0, fresh
            others = np.flatnonzero(~is_centre)
            for at in range(0, len(others), 4096):
                some = others[at : at + 4096]
                d = distances(u[some], u[fresh])
                near = d.argmin(axis=1)
                d = d[np.arange(len(some)), near]
                closer = d < away[some]
                away[some[closer]], owner[some[closer]] = d[closer], fresh[near[closer]]
        parents[k] = np.where(is_centre, above, 0)
    out = np.empty((n, len(levels)), np.int64)
    out[:, -1] = owner
    for k in range(len(levels) - 1, 0, -1):
        out[:, k - 1] = parents[k][out[:, k]]
    return out


@dataclass(frozen=True)
class Level:
    centres: np.ndarray  # vectors of the nodes' centres, single precision
    radii: np.ndarray  # distances of the farthest rows beneath
    begins: np.ndarray  # the first row beneath each node, in tree order, and the number of rows
    children: np.ndarray  # the first child in the next level, and the number of its nodes


@dataclass(frozen=True)
class Tree:
    x: np.ndarray  # unit rows in tree order, double precision
    u: np.ndarray  # the same in single precision
    rows: np.ndarray  # what a row is called
    levels: list[Level]


def tree(x: np.ndarray, found: np.ndarray, rows: np.ndarray) -> Tree:
    """The tree over unit rows ``x`` whose ``paths`` are ``found``."""
    order = np.lexsort(found.T[::-1])
    found, y = found[order], x[order]
    u, centre_of = y.astype(np.float32), x[:, :]
    levels, n = [], len(y)
    for k in range(found.shape[1]):
        begins = np.flatnonzero(np.append(True, (found[1:, : k + 1] != found[:-1, : k + 1]).any(axis=1)))
        gone = y - centre_of[found[:, k]]
        away = np.sqrt(np.einsum("ij,ij->i", gone, gone))
        centres = centre_of[found[begins, k]].astype(np.float32)
        levels.append((centres, np.maximum.reduceat(away, begins), np.append(begins, n)))
    built = []
    for k, (centres, radii, begins) in enumerate(levels):
        below = levels[k + 1][2] if k + 1 < len(levels) else begins
        built.append(Level(centres, radii, begins, np.searchsorted(below, begins)))
    return Tree(y, u, rows[order], built)


class Links:
    """What traversals find: links by weight for each row, and components of rows."""

    def __init__(self, weights: np.ndarray):
        self.counts, self.weights = np.zeros(len(weights), np.int64), weights
        self.low, self.ends, self.held = np.arange(len(weights)), [], 0

    def all_pairs(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Every row of a is linked with every (other) row of b."""
        wa, wb = self.weights[a], self.weights[b]
        if same:
            self.counts[a] += wa.sum() - wa
        else:
            self.counts[a] += wb.sum()
            self.counts[b] += wa.sum()
            self._tie(np.full(len(b), a[0]), b)
        self._tie(np.full(len(a) - 1, a[0]), a[1:])

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each row of a is linked with the row of b beside it."""
        np.add.at(self.counts, a, self.weights[b])
        np.add.at(self.counts, b, self.weights[a])
        self._tie(a, b)

    def _tie(self, a: np.ndarray, b: np.ndarray) -> None:
        self.ends.append((a, b))
        self.held += len(a)
        if self.held > HELD:
            self.components()

    def components(self) -> np.ndarray:
        """The smallest row that each one is connected to."""
        a, b = (np.concatenate([e[i] for e in self.ends] or [np.zeros(0, np.int64)]) for i in (0, 1))
        low = self.low
        while len(apart := np.flatnonzero(low[a] != low[b])):
            x, y = low[a[apart]], low[b[apart]]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low[low] != low).any():
                low = low[low]
        self.low, self.ends, self.held = low, [], 0
        return low


def traverse(one: Tree, two: Tree, cosine: float, links: Links) -> tuple[int, int]:
    """All pairs of rows of two trees (of one, if they are the same) with cosine ``cosine`` or more.

    Returns how many distances of centres and cosines of rows were computed. Single precision serves for a first look:
    only where it is within its error of the threshold, or above, the double-precision cosine decides.
    """
    same, limit = one is two, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    looked, compared = 1, 0
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    gap = distances(one.levels[0].centres, two.levels[0].centres)[0] if not same else np.zeros(1)
    for k, (la, lb) in enumerate(zip(one.levels, two.levels)):
        wide = la.radii[p] + lb.radii[q]
        whole = gap + wide < limit - MARGIN
        single = whole & (np.diff(la.begins)[p] == 1) & (np.diff(lb.begins)[q] == 1) & ~(same & (p == q))
        links.pairs(one.rows[la.begins[p[single]]], two.rows[lb.begins[q[single]]])
        for i, j in zip(p[whole & ~single].tolist(), q[whole & ~single].tolist()):
            a, b = one.rows[la.begins[i] : la.begins[i + 1]], two.rows[lb.begins[j] : lb.begins[j + 1]]
            links.all_pairs(a, b, same and i == j)
        left = (gap <= wide + limit + MARGIN) & ~whole
        p, q = p[left], q[left]
        last = k + 1 == len(one.levels)
        first, second = (la.begins, lb.begins) if last else (la.children, lb.children)
        points, others = (one.u, two.u) if last else (one.levels[k + 1].centres, two.levels[k + 1].centres)
        found = []
        for rows, cols, d in _products(first, second, p, q, points, others, last, same):
            looked, compared = looked + d.size * (not last), compared + d.size * last
            if last:
                hit = d >= cosine - 1e-4
            else:
                hit = d <= one.levels[k + 1].radii[rows] + two.levels[k + 1].radii[cols] + limit + MARGIN
            if same:
                hit &= cols >= rows + last
            r, c, d = (np.broadcast_to(v, hit.shape)[hit] for v in (rows, cols, d))
            if last and len(r):
                near = np.einsum("ij,ij->i", one.x[r], two.x[c]) >= cosine
                links.pairs(one.rows[r[near]], two.rows[c[near]])
            elif len(r):
                found.append((r, c, d))
        if last or not found:
            break
        p, q, gap = (np.concatenate([f[i] for f in found]) for i in range(3))
        if same:
            gap[p == q] = 0
            alone = (p == q) & (np.diff(one.levels[k + 1].begins)[p] == 1)
            p, q, gap = p[~alone], q[~alone], gap[~alone]
    return looked, compared


def _products(first, second, p, q, points, others, cosines: bool, same: bool):
    """(i, j, distance or cosine) of all children i of p[k] and j of q[k], in arrays that broadcast to one shape.

    A node with many pairs has a matrix of them; those of nodes with few are gathered from all nodes.
    """
    sizes = (first[p + 1] - first[p]) * (second[q + 1] - second[q])
    names, which = np.unique(p, return_inverse=True)
    large = (np.bincount(which, sizes) >= DENSE)[which] if len(p) else np.zeros(0, bool)
    order = np.flatnonzero(large)[np.argsort(p[large], kind="stable")]
    begins = np.flatnonzero(np.diff(p[order], prepend=-1))
    for part in np.split(order, begins[1:]) if len(order) else []:
        i = p[part[0]]
        cols = np.concatenate([np.arange(second[j], second[j + 1]) for j in np.sort(q[part]).tolist()])
        step = max(1, AT_ONCE // len(cols))
        for at in range(first[i], first[i + 1], step):
            rows = np.arange(at, min(at + step, first[i + 1]))
            near = cols[np.searchsorted(cols, at) :] if same else cols
            d = points[rows] @ others[near].T if cosines else distances(points[rows], others[near])
            yield rows[:, None], near[None, :], d
    few = np.flatnonzero(~large)
    upto = np.cumsum(sizes[few])
    for part in np.split(few, np.searchsorted(upto, np.arange(GATHERED, upto[-1] if len(few) else 0, GATHERED))):
        n = sizes[part]
        pair = np.repeat(part, n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        wide = second[q[pair] + 1] - second[q[pair]]
        i, j = first[p[pair]] + at // wide, second[q[pair]] + at % wide
        d = np.einsum("ij,ij->i", points[i], others[j])
        yield i, j, d if cosines else np.sqrt(np.maximum(0, 2 - 2 * d))


def first_levels(sample: np.ndarray, cells: int = FAN, centre: np.ndarray | None = None) -> np.ndarray:
    """The centres of the lowest level with at most ``cells`` of them, over unit rows; ``centre`` is the first one.

    Each level has the centres of the one above and is separated by half its reach. Without a level of several centres
    that is small enough, the first one stays alone: rows without structure are not told apart.
    """
    start = sample[:1] if centre is None else centre[None]
    if not len(sample):
        return start
    centres, reach = start, 2.0
    while reach > 1e-3:
        reach /= 2
        far = np.min(2 - 2 * sample @ centres.T, axis=1)
        chosen = [*centres]
        while far.max() > reach * reach and len(chosen) <= cells:
            k = int(far.argmax())
            chosen.append(sample[k])
            far = np.minimum(far, 2 - 2 * sample @ sample[k])
        if len(chosen) > cells:
            break
        centres = np.array(chosen)
    return centres


def near_vectors(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: ``(key, n_links, component_id, kept)``.

    ``n_links`` counts other vectors with a cosine of ``cosine`` or more in double precision, ``component_id`` is the
    smallest key reachable over links, ``kept`` tells if that is the own key. Vectors that are null, zero or hold null
    or non-finite components link with nothing, and neither do rows without a key (their component is null); vectors
    of different lengths are never linked. Equal vectors are compared once, with their number as weight. Keys are
    whole numbers and should be unique: rows of one key share their component.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = valid(vectors, key, vector).where(F.col(key).isNotNull())
    distinct = rows.groupBy("v").agg(F.min(key).alias("id"), F.count("*").alias("weight"))
    distinct = scratch.write(distinct.select("v", F.col("id").cast("long"), "weight", F.size("v").alias("dims")), "distinct")
    found = None
    for dims in sorted(r[0] for r in distinct.select("dims").distinct().collect()):
        links = _links(scratch, distinct.where(F.col("dims") == dims), dims, cosine, block)
        found = links if found is None else found.union(links)
    members = rows.join(distinct, "v").select(F.col(key).alias("_key"), "id", "weight")
    if found is None:
        members = members.withColumns({"component": F.col("id"), "links": F.lit(0).cast("long")})
    else:
        found = scratch.write(found, "found")
        totals = found.groupBy("id").agg(F.sum("links").alias("links"))
        edges = found.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
        named = connected_components(scratch, edges)
        stats = totals.join(named, F.col("id") == F.col("node"), "left").select("id", "links", "component")
        members = members.join(stats, "id", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    members = members.groupBy("_key").agg(F.min(F.coalesce("component", "id")).alias("c"), F.max(links).alias("n"))
    joined = vectors.select(key).join(members, F.col(key) == F.col("_key"), "left")
    component = F.coalesce("c", F.col(key).cast("long"))
    kept = F.coalesce(component == F.col(key), F.lit(False)).alias("kept")
    return joined.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept)


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, v)`` of vectors that take part: not null or zero, no null or non-finite component."""
    v = F.col(vector)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(key, v.alias("v")).where(v.isNotNull() & F.coalesce(sound, F.lit(False)) & (total > 0) & (total < float("inf")))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Unit rows in double precision."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _descended(rows: DataFrame, cells: list[np.ndarray], dims: int) -> DataFrame:
    """``rows(id, weight, v, cell)`` with the nearest of its cell's centres below as ``cell``, and the distance ``away``.

    The cells below cell c are numbered c * ``FAN`` and on.
    """
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    element = rows.schema["v"].dataType.simpleString()

    def descend(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, cell = _matrix(b.column(2), dims), b.column(3).to_numpy()
            below, away = np.zeros(len(x), np.int64), np.zeros(len(x))
            for c in np.unique(cell).tolist():
                at, centres = np.flatnonzero(cell == c), shared.value[c]
                near = (x[at] @ centres.T).argmax(axis=1)
                below[at] = c * FAN + near
                away[at] = np.sqrt(((x[at] - centres[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(below), pa.array(away)], names=["id", "weight", "v", "cell", "away"])

    return rows.select("id", "weight", "v", "cell").mapInArrow(descend, f"id long, weight long, v {element}, cell long, away double")


def _radii(placed: DataFrame) -> dict[int, tuple[float, int]]:
    """The radius and the number of rows of each cell; there are at most ``FAN`` * ``FAN``."""
    return {r[0]: (r[1], r[2]) for r in placed.groupBy("cell").agg(F.max("away"), F.count("*")).collect()}


def _lower_centres(scratch: Scratch, placed: DataFrame, tops: np.ndarray, sizes: dict, dims: int, block: int) -> list[np.ndarray]:
    """For each cell the centres below: those of a sample's first levels if it holds more than a block, else its own."""
    large = [c for c, (_, n) in sizes.items() if n > block]
    cells = [c[None] for c in tops]
    fan = min(FAN, CENTRES // (8 * dims * max(1, len(large))))
    if len(tops) == 1 or fan < 2 or not large:
        return cells

    def grow(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        found = first_levels(_matrix(table["v"], dims), fan, tops[cell])
        return pa.table({"cell": np.full(len(found), cell), "at": np.arange(len(found)), "centre": list(found)})

    turn = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
    some = placed.where(F.col("cell").isin(large)).select("cell", "v", turn.alias("turn")).where(F.col("turn") <= SAMPLE)
    for r in some.groupBy("cell").applyInArrow(grow, "cell long, at long, centre array<double>").orderBy("cell", "at").collect():
        if r["at"] > 0:  # the first one is the cell's own
            cells[r["cell"]] = np.vstack((cells[r["cell"]], r["centre"]))
    return cells


def _near_cells(scratch: Scratch, tops: np.ndarray, above: dict, cells: list[np.ndarray], below: dict, limit: float) -> DataFrame:
    """``(cell, cell2, gap)`` of cells that may hold near rows; pairs of upper cells are pruned first."""
    spark, wide = scratch.spark, limit + MARGIN
    gaps = np.sqrt(np.maximum(0, 2 - 2 * tops @ tops.T))
    radii = np.array([above.get(c, (-4.0, 0))[0] for c in range(len(tops))])  # a cell without rows is near none
    a, b = np.nonzero(np.triu(gaps <= radii[:, None] + radii[None, :] + wide))
    shared = spark.sparkContext.broadcast((cells, {c: r for c, (r, _) in below.items()}))

    def split(batches):
        cells, radii = shared.value
        for batch in batches:
            for c, d in zip(*(col.to_pylist() for col in batch.columns)):
                r, s = (np.array([radii.get(k * FAN + i, -4.0) for i in range(len(cells[k]))]) for k in (c, d))
                gap = np.sqrt(np.maximum(0, 2 - 2 * cells[c] @ cells[d].T))
                near = gap <= r[:, None] + s[None, :] + wide
                i, j = np.nonzero(np.triu(near) if c == d else near)
                columns = (c * FAN + i, d * FAN + j, gap[i, j])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["cell", "cell2", "gap"])

    pairs = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    return pairs.repartition(max(1, min(len(a), 64))).mapInArrow(split, "cell long, cell2 long, gap double")


def _links(scratch: Scratch, distinct: DataFrame, dims: int, cosine: float, block: int) -> DataFrame:
    """``(id, links, low)``: for a vector and a pair of blocks, its links there and a vector it is connected to."""
    spark, tag = scratch.spark, f"-{dims}"
    limit, levels = float(np.sqrt(max(0.0, 2 - 2 * cosine))), reaches(cosine)
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    units = np.array([np.asarray(v, np.float64) for v in sample])
    units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
    tops = first_levels(units, min(FAN, max(1, CENTRES // (8 * dims))))
    upper = _descended(distinct.withColumn("cell", F.lit(0).cast("long")), [tops], dims)
    upper = scratch.write(upper, "upper" + tag)
    above = _radii(upper)
    cells = _lower_centres(scratch, upper, tops, above, dims, block)
    placed = scratch.write(_descended(upper, cells, dims), "placed" + tag)
    below = _radii(placed)

    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    element = distinct.schema["v"].dataType.simpleString()

    def plant(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        found = paths(_matrix(table["v"], dims).astype(np.float32), levels)
        lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(levels), dtype=np.int32), found.astype(np.int32).ravel())
        return table.append_column("at", pa.array(np.arange(len(order), dtype=np.int32))).append_column("path", lists)

    schema = f"cell long, part long, away double, id long, weight long, v {element}, at int, path array<int>"
    planted = dealt.select("cell", "part", "away", "id", "weight", "v").groupBy("cell", "part").applyInArrow(plant, schema)
    planted = scratch.write(planted, "planted" + tag)
    blocks = planted.groupBy("cell", "part").agg(F.max("away").alias("radius"))
    near = _near_cells(scratch, tops, above, cells, below, limit)
    other = blocks.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("radius").alias("radius2"))
    pairs = blocks.join(near, "cell").join(other, "cell2")
    pairs = pairs.where((F.col("cell") < F.col("cell2")) | (F.col("part") <= F.col("part2")))
    pairs = pairs.where(F.col("gap") <= F.col("radius") + F.col("radius2") + limit + MARGIN)
    pairs = scratch.write(pairs.select("cell", "part", "cell2", "part2", F.monotonically_increasing_id().alias("pair")), "pairs" + tag)
    one = pairs.select("pair", "cell", "part", F.lit(0).alias("side"))
    two = pairs.where("cell <> cell2 or part <> part2").select("pair", F.col("cell2").alias("cell"), F.col("part2").alias("part"), F.lit(1).alias("side"))
    tasks = planted.join(one.union(two), ["cell", "part"]).select("pair", "side", "id", "weight", "v", "at", "path")

    def compare(table: pa.Table) -> pa.Table:
        order = np.argsort(table["side"].to_numpy().astype(np.int64) << 32 | table["at"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        x = _matrix(table["v"], dims)
        found = table["path"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(x), -1)
        links, planted = Links(table["weight"].to_numpy()), []
        for s in (0, 1):
            if len(mine := np.flatnonzero(side == s)):
                planted.append(tree(x[mine], found[mine], mine))
        traverse(planted[0], planted[-1], cosine, links)
        low = np.full(len(x), np.iinfo(np.int64).max)
        group = links.components()
        np.minimum.at(low, group, ids)
        hit = np.flatnonzero(links.counts)
        return pa.table({"id": ids[hit], "links": links.counts[hit], "low": low[group[hit]]})

    return tasks.groupBy("pair").applyInArrow(compare, "id long, links long, low long")
