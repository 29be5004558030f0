"""SimHash near-duplicates by meet-in-the-middle ball hashing.

``near_duplicates`` links fingerprints by their differing bits, ``keep_one`` texts by the Jaccard similarity of their
shingles.

Two fingerprints within 2*r bits have a common variant within r bits of each. So every distinct fingerprint emits all
its variants within r bits (65 for r = 1), rows meet by variant, and fingerprints that meet are linked after their
distance is verified. For r = 1 a variant is shared by at most 65 distinct fingerprints, however many documents there
are: equal fingerprints are folded before, so no key can become hot. Members of a bucket are linked to its smallest
member only; any two that are close enough share a bucket, and those of a bucket are all within 2*r bits of each other,
so that no component is lost and the links stay linear in the number of fingerprints.

Texts that share four fifths of their shingles differ in about a sixth of all bits, too many for one ball. Their long
fingerprints are cut into parts, and a part's ball is that of half the radius (``HALF``) within its least certain bits,
those whose counts are nearest to a draw, as these are the ones that edits turn over. A text of which less than four
fifths of the shingles occur in any other text has no partner and takes no part. Pairs that meet in any part are compared
by 64 more bits and by the bound that their shared shingles set, and then exactly.

A few shingles say too little of each bit. Where one of two texts has at most ``SHORT`` of them, the ball is one of sets:
texts emit their subsets that a similar text can have in common with them, and similar texts meet in what they share.
"""

from __future__ import annotations

import math
import string
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linescope.llm import tokens
from linescope.llm.common import Scratch, partitions
from linescope.llm.components import connected_components

BITS = 64
#: Shingles that are hashed before their bits are counted.
BLOCK = 1 << 16
#: Similarity of texts: words of a shingle, the least Jaccard similarity of a link, and the share of pairs just there that
#: may share no variant.
WORDS, SIMILARITY, LOST = 5, 0.8, 0.008
#: A part's ball: half the radius, and the bits that may be turned over.
HALF, UNCERTAIN = 2, 8
#: Most of the 64 bits for a first look that may differ: 10 are expected at a similarity of 0.8, with a deviation of 3.
APART = 22
#: Shingles of a text up to which its pairs are found by common subsets, all of them.
SHORT = 14
#: Shingles in a bucket in which they are counted, and what stands there for several texts.
IN_BUCKET, SHARED = 1 << 21, -(1 << 63)
#: The part of nodes that meet by common subsets.
BY_SUBSET = -1
#: Classes of shingles in which two texts' counts are compared before the texts are.
CLASSES = 32


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text: bit i is set if it is set in over half of the shingles' XXH64 values.

    Words are runs of anything but space and \\x09-\\x0D, A-Z lower-cased; shingles are ``words`` words with single
    spaces, repeats included. Fewer words make one shingle; none (or null) give 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    hashed, ones = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        found = b"".join([hashed(line[s:e], seed) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])
        ones += np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``(key, fp long)``, one row per row of ``docs``."""
    kind = docs.schema[key].dataType

    def hashed(batches):
        for b in batches:
            fps = [fingerprint(t, words, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("fp", T.LongType())])
    return docs.select(key, text).mapInArrow(hashed, schema)


def ball(radius: int) -> list[int]:
    """All signed 64-bit masks with at most ``radius`` bits set."""
    masks = [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def near_links(folded: DataFrame, distance: int = 2) -> DataFrame:
    """Edges ``(a, b)`` between the representatives in ``folded(fp, rep)``, fingerprints being distinct.

    The components of these edges are those of all pairs at ``distance`` or fewer differing bits. ``distance`` is even:
    half of it is the balls' radius, and only then are all members of a bucket near each other.
    """
    if distance < 0 or distance % 2:
        raise ValueError("distance must be an even number of bits")
    masks = F.array(*[F.lit(m) for m in ball(distance // 2)])
    spread = folded.select("fp", "rep", F.explode(masks).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", "rep"
    )
    bucket = Window.partitionBy("variant").orderBy("rep")
    return (
        spread.select("rep", "fp", F.first("rep").over(bucket).alias("low"), F.first("fp").over(bucket).alias("other"))
        .where("rep <> low")
        .select(F.col("rep").alias("a"), F.col("low").alias("b"), "fp", "other")
        .distinct()
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, distance: int = 2, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(key, fingerprint, component_id)``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest key reachable over links of at most
    ``distance`` differing bits, the own key included. Null and empty texts have fingerprint zero and are linked like
    any other. Rows with the same key are one document: their texts' groups are joined. Rows without a key get the
    component of their fingerprint's group, null if no row of it has a key. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.write(fingerprints(docs, key, text, words), "fps")
    folded = fps.groupBy("fp").agg(F.min(key).alias("rep"))
    keyed = folded.where("rep is not null")
    # rows of one key with several fingerprints tie those fingerprints together
    several = fps.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    tied = fps.join(several, key).join(keyed, "fp").select(F.col(key).alias("a"), F.col("rep").alias("b"))
    found = connected_components(scratch, near_links(keyed, distance).union(tied))
    classes = folded.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(classes, "fp").select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def node(text: Column) -> Column:
    """A number of a text's words (as ``fingerprint`` takes them), the same for null, empty and blank texts."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.xxhash64(F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " ")))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 values of all runs of ``words`` words, ascending; fewer words are one run, none have none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    hashed = xxhash.xxh64_digest
    found = b"".join([hashed(line[s:e]) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist())])
    return np.unique(np.frombuffer(found, ">u8").astype(np.uint64))


def shape(rows: int) -> tuple[int, int]:
    """Parts and bits of a part for a table of ``rows`` texts.

    Parts widen with the table, so that the unrelated texts that share a variant stay few; at 32 bits a pair of
    similarity 0.8 shares a variant of a part with a probability of 0.33, which falls by 8 % with each further bit. There
    are so many parts that all but ``LOST`` of such pairs share one.
    """
    width = max(32, math.ceil(math.log2(rows + 1)) + 8)
    met = 0.33 * math.exp(-0.084 * (width - 32))
    return math.ceil(math.log(LOST) / math.log(1 - met)), width


_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, (2, 1024), np.uint64) * np.uint64(2) + np.uint64(1)


def long_fingerprint(found: np.ndarray, parts: int, width: int) -> tuple[int, np.ndarray]:
    """64 bits for a first look as a signed number, and for each part its bits and its ``UNCERTAIN`` least certain ones.

    The latter are rows of bytes: eight of the part's value, then the places of its uncertain bits.
    """
    n, number = len(found), 1 + -(-parts * width // BITS)
    times, plus = _SEEDS[0, :number], _SEEDS[1, :number]
    ones = np.zeros(number * BITS, np.int64)
    for at in range(0, n, 255):
        h = found[at : at + 255, None] * times + plus
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    margins = ones * 2 - n
    look = int(np.packbits(margins[:BITS] > 0).view(">i8")[0])
    margins = margins[BITS : BITS + parts * width].reshape(parts, width)
    values = ((margins > 0).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    places = np.argsort(np.abs(margins), axis=1, kind="stable")[:, :UNCERTAIN].astype(np.uint8)
    return look, np.concatenate((values.view(np.uint8).reshape(parts, 8), places), axis=1)


def variants(faces: np.ndarray, width: int) -> np.ndarray:
    """All variants of all parts, with the part's number before them: texts x parts x variants, from their bytes."""
    values = np.ascontiguousarray(faces[:, :, :8]).view(np.uint64)
    bits = np.uint64(1) << faces[:, :, 8:].astype(np.uint64)
    masks = [np.zeros(faces.shape[:2], np.uint64)]
    for size in range(1, HALF + 1):
        masks += [np.bitwise_or.reduce(bits[:, :, list(at)], axis=2) for at in combinations(range(UNCERTAIN), size)]
    part = np.arange(faces.shape[1], dtype=np.uint64)[None, :, None] << np.uint64(width)
    return (values ^ np.stack(masks, axis=2) | part).astype(np.int64)


def signatures(texts: DataFrame, words: int, parts: int, width: int) -> DataFrame:
    """``(node, size, look, faces)`` of ``texts(node, text)``: how many shingles, and their fingerprint."""

    def hashed(batches):
        for b in (s for batch in tokens.tidied(batches) for s in tokens.slices(batch, 1, tokens.FEW)):
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            prints = [long_fingerprint(s, parts, width) for s in sets]
            columns = [b.column(0), pa.array(map(len, sets), pa.int64()), pa.array([p[0] for p in prints], pa.int64())]
            columns.append(pa.array([p[1].tobytes() for p in prints], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "look", "faces"])

    return texts.select("node", "text").mapInArrow(hashed, "node long, size long, look long, faces binary")


def shared_shingles(texts: DataFrame, words: int, buckets: int) -> DataFrame:
    """``(node, shared)``: how many shingles of a text occur in another one of ``texts(node, text)``, nodes being distinct.

    Shingles are dealt into buckets by their hash. One that several texts of a slice have is counted where it is and goes
    to its bucket once, so that a very common one is only as often there as there are slices. A bucket's counts go to the
    places of their nodes, a row for each place: a row for each node and bucket would be many more with more buckets.
    """

    def deal(batches):
        for b in (s for batch in tokens.tidied(batches) for s in tokens.slices(batch, 1, tokens.FEW)):
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            found, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            distinct, which, counts = np.unique(found, return_inverse=True, return_counts=True)
            often = counts[which] > 1
            nodes = b.column(0).to_numpy()
            here = np.bincount(owner[often], minlength=len(sets))
            counted = [pa.array([-1], pa.int64()), pa.array([here.astype("<i8").tobytes()]), pa.array([nodes.astype("<i8").tobytes()])]
            yield pa.RecordBatch.from_arrays(counted, names=names)
            hashes = np.concatenate((distinct[counts > 1], found[~often]))
            mine = np.concatenate((np.full(int((counts > 1).sum()), SHARED), nodes[owner[~often]]))
            place = (hashes >> np.uint64(32)) % np.uint64(buckets)
            order = np.lexsort((mine, place))
            begins = np.flatnonzero(np.diff(place[order], prepend=np.uint64(buckets)))
            at = np.append(begins, len(order)).tolist()
            hashes, mine = hashes[order].astype("<u8"), mine[order].astype("<i8")
            columns = [[hashes[i:j].tobytes() for i, j in zip(at, at[1:])], [mine[i:j].tobytes() for i, j in zip(at, at[1:])]]
            yield pa.RecordBatch.from_arrays([pa.array(place[order][begins].astype(np.int64)), *(pa.array(c, pa.binary()) for c in columns)], names=names)

    def joined(column) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, "<i8") for x in column.to_pylist()])

    def counted_here(batches):
        for b in batches:
            for i in range(b.num_rows):
                found = [pa.array(joined(b.column(c).slice(i, 1))) for c in (2, 1)]
                yield pa.RecordBatch.from_arrays(found, names=["node", "shared"])

    def count(table: pa.Table) -> pa.Table:
        left, mine = joined(table["left"]), joined(table["nodes"])
        _, which, counts = np.unique(left, return_inverse=True, return_counts=True)
        found, shared = np.unique(mine[(counts[which] > 1) & (mine != SHARED)], return_counts=True)
        place = (found.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        begins = np.flatnonzero(np.diff(place[order], prepend=-1))
        at = np.append(begins, len(order)).tolist()
        columns = [[x[order[i:j]].astype("<i8").tobytes() for i, j in zip(at, at[1:])] for x in (found, shared)]
        return pa.table([pa.array(place[order][begins]), *(pa.array(c, pa.binary()) for c in columns)], names=["place", "nodes", "shared"])

    def summed(table: pa.Table) -> pa.Table:
        found, which = np.unique(joined(table["nodes"]), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, which, joined(table["shared"]))
        return pa.table({"node": found, "shared": total})

    names = ["bucket", "left", "nodes"]
    dealt = texts.select("node", "text").mapInArrow(deal, "bucket long, left binary, nodes binary")
    here = dealt.where("bucket < 0").mapInArrow(counted_here, "node long, shared long")
    there = dealt.where("bucket >= 0").groupBy("bucket").applyInArrow(count, "place long, nodes binary, shared binary")
    there = there.groupBy("place").applyInArrow(summed, "node long, shared long")
    return here.union(there).groupBy("node").agg(F.sum("shared").alias("shared"))


def met(nodes: DataFrame, parts: int, width: int) -> DataFrame:
    """``(part, leader, rank, node)``: nodes with a variant of a part that another one, the leader, has too.

    A bucket's leader is the node with the fewest shingles of its own (``alone``), the likeliest to be near the others;
    how many these are is its rank.
    """

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                faces = np.frombuffer(b"".join(some.column(2).to_pylist()), np.uint8).reshape(some.num_rows, parts, -1)
                found = variants(faces, width)
                names, alone = (np.repeat(some.column(c).to_numpy(), found[0].size) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(alone), pa.array(found.ravel())], names=["node", "alone", "bucket"])

    rows = nodes.select("node", "alone", "faces").mapInArrow(spread, "node long, alone long, bucket long")
    least = F.first(F.struct("node", "alone")).over(Window.partitionBy("bucket").orderBy("alone", "node"))
    rows = rows.select(F.shiftright("bucket", width).alias("part"), least.alias("least"), "node")
    rows = rows.select("part", F.col("least.node").alias("leader"), F.col("least.alone").alias("rank"), "node")
    return rows.where("node <> leader").distinct()


def common_subsets(found: np.ndarray, similarity: float, most: int = SHORT) -> np.ndarray:
    """Hashes (sums) of the subsets of at most ``most`` shingles that a text of this similarity can share with this one."""
    n, total = len(found), found.astype(np.uint64).sum(dtype=np.uint64)
    least = math.ceil(similarity * n - 1e-9)
    out = []
    for size in range(max(1, least), min(n, most) + 1):
        gone = np.array(list(combinations(range(n), n - size)), np.int64).reshape(math.comb(n, size), n - size)
        out.append(total - found[gone].sum(axis=1, dtype=np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def short_pairs(scratch: Scratch, sets: DataFrame, similarity: float) -> DataFrame:
    """``(part, leader, rank, node)``: ``shingled`` sets with a leader's subset; components of such links are all short links.

    The leader of a subset is the smallest set that has it. If two others are similar by what they share there, each of
    them is to the leader too, as that adds the least: so no pairs among followers are needed.
    """
    longest = math.floor(SHORT / similarity + 1e-9)

    def spread(batches):
        for b in batches:
            nodes, lists = b.column(0).to_numpy(), [np.array(s, np.int64).view(np.uint64) for s in b.column(1).to_pylist()]
            found = [common_subsets(s, similarity) for s in lists]
            sizes = [len(f) for f in found]
            columns = [np.repeat(nodes, sizes), np.repeat([len(s) for s in lists], sizes), np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["node", "size", "subset"])

    some = sets.where(F.size("shingles").between(1, longest))
    rows = scratch.write(some.mapInArrow(spread, "node long, size long, subset long"), "subsets")
    leaders = rows.groupBy("subset").agg(F.min(F.struct("size", "node")).alias("least"), F.count("*").alias("n")).where("n > 1")
    leaders = leaders.select("subset", F.col("least.node").alias("leader"), F.col("least.size").alias("rank"))
    led = rows.join(scratch.write(leaders, "leaders"), "subset").where("leader <> node")
    return led.select(F.lit(BY_SUBSET).alias("part"), "leader", "rank", "node").distinct()


def shingled(texts: DataFrame, words: int) -> DataFrame:
    """``(node, shingles)`` of ``texts(node, text)``."""

    def hashed(batches):
        for b in (s for batch in tokens.tidied(batches) for s in tokens.slices(batch, 1, tokens.FEW)):
            sets = [shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(hashed, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose ``shingled`` sets agree by ``similarity`` or more."""
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    joined = pairs.join(two, "b").join(one, "a")
    both = joined.withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(F.col("both") >= (F.size("set_a") + F.size("set_b") - F.col("both")) * F.lit(similarity) - F.lit(1e-9)).select("a", "b")


def similar_nodes(scratch: Scratch, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between nodes of ``texts(node, text)``, nodes being distinct.

    Their components are those of all pairs that meet in a bucket and agree by ``similarity`` or more, and of all such
    pairs with a node of at most ``SHORT`` shingles. Nodes are compared with the leaders of their buckets. A near copy in
    a large group has hundreds of them, most of which are near copies too: each node is compared with its first leader
    before, then with its first one of those that this leaves in other components, and with all others only where they
    still are in other components. So links are about as many as nodes. A leader's followers that all these links leave in different components are compared after that (``across``).
    """
    parts, width = shape(texts.count())
    signed = scratch.write(signatures(texts, words, parts, width), "signed")
    total = signed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shared = shared_shingles(texts, words, max(partitions(scratch.spark), -(-total // IN_BUCKET)))
    enough = F.col("shared") >= F.col("size") * F.lit(similarity) - F.lit(1e-9)
    nodes = scratch.write(signed.join(shared, "node").where(enough).withColumn("alone", F.col("size") - F.col("shared")), "nodes")
    stats = nodes.select("node", "size", "look", "shared")
    followers = scratch.write(met(nodes, parts, width), "followers")
    few = nodes.where(F.col("size") <= math.floor(SHORT / similarity + 1e-9)).select("node")
    asked = followers.select("node").union(followers.select("leader")).union(few).distinct()
    held = scratch.write(shingled(texts.join(asked, "node", "left_semi"), words), "sets")
    followers = followers.union(scratch.write(short_pairs(scratch, held, similarity), "short"))
    # a node has as many places as it has variants at most: its component is joined once, and goes with all of them
    members = followers.union(followers.select("part", "leader", "rank", "leader").distinct())
    places = members.groupBy("node").agg(F.collect_list(F.struct("rank", "leader", "part")).alias("places"))
    least = lambda short: F.array_min(F.filter("places", lambda p: (p["leader"] != F.col("node")) & ((p["part"] == BY_SUBSET) == F.lit(short))))
    places = scratch.write(places.select("node", "places", least(False).alias("by_bits"), least(True).alias("by_subset")), "places")

    def near(x: str, y: str) -> Column:
        """A first look at two rows: by what they can have in common at most, and by the 64 bits."""
        common, both = F.least(f"{x}.shared", f"{y}.shared"), F.col(f"{x}.size") + F.col(f"{y}.size")
        common = F.least(common, f"{x}.size", f"{y}.size")
        fits = common >= (both - common) * F.lit(similarity) - F.lit(1e-9)
        return fits & (F.bit_count(F.col(f"{x}.look").bitwiseXOR(F.col(f"{y}.look"))) <= APART)

    def worth(led: DataFrame) -> DataFrame:
        """``(a, b)``: of rows ``(part, leader, node)`` the pairs to verify; those that share a subset need no first look."""
        led = led.select(F.col("leader").alias("a"), F.col("node").alias("b"), (F.col("part") == BY_SUBSET).alias("short")).distinct()
        looked = led.where("not short").join(stats.alias("x"), F.col("a") == F.col("x.node")).join(stats.alias("y"), F.col("b") == F.col("y.node"))
        return looked.where(near("x", "y")).select("a", "b").union(led.where("short").select("a", "b")).distinct()

    def placed(found: DataFrame) -> DataFrame:
        """``(node, component, first, rank, leader, part)``: all members of leaders' groups, the leaders too; ``first`` is a node's first leader."""
        component, first = F.coalesce("component", "node").alias("component"), F.when(by_subset, F.col("by_subset.leader")).otherwise(F.col("by_bits.leader"))
        rows = places.join(found, "node", "left").select("node", component, "by_bits", "by_subset", F.inline("places"))
        return rows.select("node", "component", first.alias("first"), "rank", "leader", "part")

    led_by, by_subset = Window.partitionBy("part", "leader"), F.col("part") == BY_SUBSET
    theirs = F.max(F.when(F.col("node") == F.col("leader"), F.col("component"))).over(led_by)
    firsts = places.select("node", "by_bits.*").union(places.select("node", "by_subset.*")).where("leader is not null")
    tried = scratch.write(worth(firsts), "pairs")
    found = connected_components(scratch, scratch.write(verified(tried, held, similarity), "links"), "first")
    for turn in ("next", "others"):
        asked = placed(found).withColumn("theirs", theirs).where("component <> theirs and leader <> first")
        if turn == "next":
            asked = asked.groupBy("node", by_subset).agg(F.min(F.struct("rank", "leader", "part")).alias("least")).select("node", "least.*")
        fresh = scratch.write(worth(asked).join(tried, ["a", "b"], "left_anti"), f"pairs-{turn}")
        links = scratch.write(verified(fresh, held, similarity), f"links-{turn}")
        links = links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found, tried = connected_components(scratch, links, turn), tried.union(fresh)

    mixed = placed(found).where(~by_subset)
    mixed = mixed.withColumns({"low": F.min("component").over(led_by), "high": F.max("component").over(led_by)}).where("low < high")
    left = mixed.select("node", "component").distinct()
    left = scratch.write(left.join(held, "node"), "left")
    second = across(scratch, left, similarity).join(tried, ["a", "b"], "left_anti")
    second = scratch.write(verified(second, held, similarity), "more")
    return found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second)


def across(scratch: Scratch, left: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: pairs of nodes of ``left(node, component, shingles)`` in different components that can be similar.

    Of two similar sets a fifth of each one's shingles, those that the fewest sets have, must have one in common. So
    nodes meet by such shingles, and texts that share only what very many share do not meet at all. Of the nodes that
    meet, those of the commonest component are compared with the others, not with each other. Of ``CLASSES`` classes of
    shingles two nodes have no more in common than either shares with any other node, class by class: a pair for which
    the sum of these is too little is none, and texts of one template that were edited in different places do not meet.
    """
    size = F.size("shingles")
    each = scratch.write(left.select("node", "component", size.alias("size"), F.explode("shingles").alias("s")), "each")
    often = scratch.write(each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "often")
    shared = each.join(often, "s")
    of_node = Window.partitionBy("node")
    turn, many = F.row_number().over(of_node.orderBy("n", "s")), F.count("*").over(of_node)
    classes = {f"c{i}": F.count_if(F.pmod("s", F.lit(CLASSES)) == i).over(of_node).cast("int") for i in range(CLASSES)}
    # shingles that no other set has come first: as many of the places are theirs
    places = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9)) + 1 - (F.col("size") - F.col("many"))
    rare = shared.withColumns({"turn": turn, "many": many, **classes}).where(F.col("turn") <= places)
    rare = scratch.write(rare.select("s", "node", "component", "size", "many", *classes), "rare")
    counts = rare.groupBy("s", "component").agg(F.count("*").alias("n"))
    commonest = counts.groupBy("s").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds"))
    commonest = scratch.write(commonest.where("kinds > 1").select("s", "main"), "commonest")
    others = scratch.write(rare.join(commonest, "s").where("component <> main").drop("main"), "others")
    x, y = rare.alias("x"), others.alias("y")
    needed = (F.col("x.size") + F.col("y.size")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    by_class = reduce(add, [F.least(f"x.{c}", f"y.{c}") for c in classes])
    close = (F.least("x.many", "y.many") >= needed) & (by_class >= needed)
    pairs = y.join(x, (F.col("x.s") == F.col("y.s")) & (F.col("x.component") != F.col("y.component")) & close)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that stay when each group of near-duplicates keeps its smallest key.

    Rows are linked if their sets of ``words``-word shingles agree by ``similarity`` (0.8 or more) or more (Jaccard), or
    if they have the same key. Null, empty and blank texts are equal. Of several rows with the smallest key, the one with
    the smallest text stays; a group without any key keeps one row.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"balls are wide enough for a similarity of {SIMILARITY} or more")
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(key).alias("key"), node(F.col(text)).alias("node"), F.col(text).alias("text"))
    rows = scratch.write(named.select("key", "node"), "rows")
    texts = scratch.write(named.groupBy("node").agg(F.min("text").alias("text")), "texts")
    links = similar_nodes(scratch, texts, words, similarity)
    tied = rows.where("key is not null").groupBy("key").agg(F.min("node").alias("a"))
    tied = rows.join(tied, "key").where("node <> a").select("a", F.col("node").alias("b"))
    found = connected_components(scratch, links.union(tied), "all")
    groups = rows.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    least = scratch.write(groups.groupBy("component").agg(F.min("key").alias("key"), F.min("node").alias("node")), "least")
    whole = docs.select(F.col(key).alias("own"), F.col(text).alias("body"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = F.row_number().over(Window.partitionBy("key").orderBy("body"))
    keyed = whole.join(least.select("key"), F.col("own") == F.col("key")).withColumn("turn", one)
    keyed = keyed.where("turn = 1").select("row.*")
    bare = least.where("key is null").select("node")
    if bare.isEmpty():
        return keyed
    turn = F.row_number().over(Window.partitionBy("node").orderBy("body"))
    chosen = whole.where("own is null").join(bare, node(F.col("body")) == F.col("node")).withColumn("turn", turn)
    return keyed.union(chosen.where("turn = 1").select("row.*"))
