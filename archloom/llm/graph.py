"""Connected components by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (u long, v long), in any direction, with or without repeats and loops.

    Returns (node, root): every node of an edge that isn't a loop, and the smallest node of its
    component. Large-star and small-star rounds shrink every component to a star around its
    smallest node in O(log**2 n) rounds; a round shuffles each edge a fixed number of times, with
    minima combined before the shuffle, so a node with many edges isn't gathered in one task.
    """
    now = staged(_oriented(edges.select("u", "v")), name)
    seen = None
    while not now.isEmpty():
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _oriented(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = _oriented(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))))
        new = staged(small, name)
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if sign == seen:
            break
        seen = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Without loops and repeats, the larger node first."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
