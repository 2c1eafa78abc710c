"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.scratch import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def _hook(pairs: DataFrame, keep) -> DataFrame:
    """Join each (u, v) with m = min over u and its v's; the minima are stored, so a hot u can be split."""
    mins = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
    joined = pairs.join(mins, "u")
    return keep(joined)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node of an undirected edge table; component is the least node.

    Self-loops make single-node components; null ends are ignored. Each step is a
    pre-aggregated minimum and one join, O(log^2 n) steps in all; nothing is collected.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    now = materialise(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hook(both, lambda j: j.where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialise(large.where("v <= u").distinct(), "large")
        small = _hook(
            large, lambda j: j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(j.select("u", F.col("m").alias("v")))
        )
        now = materialise(small.distinct(), "small")
        fresh = _fingerprint(now)
        if fresh == seen:
            break
        seen = fresh
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
