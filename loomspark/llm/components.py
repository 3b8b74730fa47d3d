"""Connected components by alternating large-star and small-star contraction.

The least neighbours are written out before they are joined to the links: both sides of that join then come straight from a
shuffle, so a node with very many links is split by AQE.
Rounds have as many partitions as their links need, not as many as a shuffle has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links for each partition on average, and the least partitions: a shuffle's many empty ones would each be a task with its files.
PART_ROWS, LEAST_PARTS = 20_000, 8


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each larger neighbour of a node goes to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """A node and its smaller neighbours go to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of links u, v (long): node and root, the least node of its component, for every node that has a link.

    Loops and repeated links do no harm; no links: no rows.  Every round is written to the shared folder; rounds grow with the
    logarithm of a component's size.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = max(LEAST_PARTS, -(-edges.count() // PART_ROWS))  # no round has more links than there are at first
    edges, state = edges.coalesce(parts), None
    while True:  # every round lowers some node's root until none can fall
        edges = cut(_small_star(cut(_large_star(edges, parts).coalesce(parts)), parts).coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().coalesce(parts))
