"""Connected components of an edge table, without gathering it: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.session import materialize

STEPS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """(u, v), u > v. Each node's neighbours (the larger or the smaller ones) are tied to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.filter("v > u") if large else both.select("u", "v").unionByName(least.select("u", F.col("u").alias("v")))
    out = near.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: bigint); the root is the component's least node.

    A step groups by node with partial aggregation and joins the minima back, so a node of many edges is split by AQE.
    Each pair of steps is written to the shared folder; the number of pairs grows with the logarithm of a component's
    diameter. Null ends and loops are dropped; repeated edges count once; no edges give no rows.
    """
    e = edges.filter("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(STEPS):
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
        e = materialize(_stars(_stars(e, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {STEPS} steps")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
