"""Connected components of a table of links by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelight.llm.common import Scratch

#: Far above the O(log^2 n) steps that any graph takes; reaching it is an error, not a result.
MOST_STEPS = 60


def components(edges: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """(node, root) of each node with a link: root is the smallest node of its component.

    edges: columns a and b of one orderable type; loops, repeats and either direction are fine. Each step is a
    shuffle by node with map-side minima; a hub's rows are split by adaptive skew joins, no group is collected.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    cur, seen = scratch.write(edges.distinct(), f"{name}0"), None
    for step in range(1, MOST_STEPS):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}{step}")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}{step - 1}")
        cur = new
        if state == seen:
            nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"links did not settle in {MOST_STEPS} steps")
