"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two equi-joins. A node with very many links is only ever the key of a minimum, which
is combined before the shuffle, or the skewed side of a sort-merge join. The minima are written before they are joined:
both sides of a join then have an exchange of their own, which adaptive execution needs to split the skewed side. No
list of neighbours is gathered. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linescope.llm.common import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """``edges(a long, b long)`` to ``(node, component)``, component being the smallest node reachable.

    Loops and repeated edges are ignored, and so are edges with a null end. Nodes without an edge are not returned.
    """
    big, small = F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")
    links = scratch.write(edges.where("a <> b").select(big, small).distinct(), f"{tag}-0")
    seen, step = _signature(links), 0
    while seen[0]:
        ends = links.select(F.col("small").alias("node"), F.col("big").alias("other")).union(links.select("big", "small"))
        least = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        least = scratch.write(least, f"{tag}-least-{step}")
        large = hung_lower(links, least)
        lowest = scratch.write(large.groupBy("big").agg(F.min("small").alias("low")), f"{tag}-lowest-{step}")
        hung = large.join(lowest.withColumnRenamed("big", "own"), F.col("big") == F.col("own")).where("small <> low")
        fresh = hung.select(F.col("small").alias("big"), F.col("low").alias("small")).union(lowest).distinct()
        step += 1
        links = scratch.write(fresh, f"{tag}-{step}")
        for done in ("", "least-", "lowest-"):
            scratch.drop(f"{tag}-{done}{step - 1}")
        now = _signature(links)
        if now == seen:
            break
        seen = now
    stars = links.select(F.col("big").alias("node"), F.col("small").alias("component"))
    return stars.union(links.select("small", "small").distinct())


def hung_lower(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each link's larger node with the least node that its smaller one sees, ``least(node, m)``."""
    return links.join(least, F.col("small") == F.col("node")).select("big", F.col("m").alias("small"))


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small"))).first())
