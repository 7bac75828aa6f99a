"""Connected components by alternating large-star and small-star steps: no driver state, no growing neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.staging import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour (large: above, small: not above) of a node to the smallest id around it. The smallest id is a
    combinable minimum, and the join spreads a hub's edges over tasks."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): component is the smallest node reachable over the edges (u, v); only nodes with an edge appear."""
    mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    step, seen = 0, None
    current = scratch.keep(edges.where("u <> v").distinct(), f"{name}-0")
    while True:
        step += 1
        following = scratch.keep(_stars(_stars(current, True), False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = following.agg(*mark).first()
        if now == seen:
            break
        seen, current = now, following
    stars = following
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
