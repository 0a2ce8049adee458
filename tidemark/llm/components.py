"""Distributed union-find: connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u, v) with u > v; the same connectivity, flatter."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("low"))
    small = large.join(least, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return small.union(least.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that an edge names; component is the least node reachable.

    Edges are undirected; null ends, loops and repeated edges are ignored, an empty table gives an
    empty result.  Each round pre-aggregates by node, so a hub costs one row a task; the joins are
    on (node, least neighbour), which adaptive execution can split.  Edges never reach the driver,
    only a count and a checksum a round.
    """
    a, b = F.col(left), F.col(right)
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seal = _seal(now)
    for _ in range(max_rounds):
        if not seal[0]:
            break
        now = cut(_stars(now))
        seal, before = _seal(now), seal
        if seal == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _seal(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
