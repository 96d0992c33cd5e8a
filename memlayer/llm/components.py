"""Connected components by alternating large-star and small-star steps.

Each step is two grouped minima and two equi-joins over the edges; labels, edges and nodes stay
distributed. A step's edges are written to the shared folder, so the lineage never grows and a
lost executor repeats one step at most. The number of steps grows with the logarithm of the
largest component; edges that are stars already, each with its smallest id, need none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlayer.llm.common import discard, materialize


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: no node has two lesser ends, and none that has one is such an end itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def stars(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """:func:`components` without the rows of the smallest ids, which are their own components."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = materialize(now, "edges")
    for _ in range(max_steps):
        if _settled(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = now.join(least, now.b == least.u).select("a", F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # a node's edge to its least end stays, the others lead from those ends to it
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        following = materialize(small, "edges")
        discard(now)
        now = following
    else:
        raise RuntimeError(f"no fixed point after {max_steps} steps")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """``edges(a, b)`` of integer ids -> ``(id, component)``, component the smallest id reachable.

    Self-loops, repeated edges and either direction are fine; null ends are ignored. Ids without
    an edge are not listed. An empty input gives an empty result.
    """
    found = stars(edges, max_steps)
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
