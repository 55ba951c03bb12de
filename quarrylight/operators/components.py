"""Connected components of a graph given as a table of links.

Alternating large-star and small-star rounds: every round links the larger
neighbours of a vertex to its least neighbour, then the smaller ones.  Each
round is a grouped minimum (combined on the map side) and a join by vertex; no
neighbourhood is ever gathered, so a hub is as good as any vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round over links u > v."""
    sides = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select("u", "v")
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    moved = sides.join(least, F.col("u") == F.col("w"))
    if large:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """``vertex, component`` for every vertex with a link to another: the component is its least vertex.

    Null ends and loops are left out; repeated links count once.  An empty table
    gives an empty one.
    """
    now = cut(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    state = None
    for _ in range(rounds):
        now = cut(_star(_star(now, True), False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        state = tuple(seen)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
