"""Connected components of an edge table by alternating large-star and small-star steps; all of it stays in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Scratch


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs(u, v), u > v. Large: every larger neighbour of u goes to the least of u and its neighbours. Small: every smaller one, and u."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, label) for every node with an edge: label is the least node that it reaches. edges(a, b): long.

    No edge gives no row. The state is written after each round, so that a lost executor costs one round at most.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        new = scratch.keep(_star(_star(now, True), False), "edges")
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(now)
        now = new
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
