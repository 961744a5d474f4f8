"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregate (the smallest neighbour of a node) and one join; no neighbourhood is
ever collected.  Steps are written to the caller's workspace, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v")))


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame, ws: common.Workspace) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long) that is not its component's smallest.

    Loops, repeated edges and either direction are allowed; null ends are left out.
    """
    tidy = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    tidy = ws.written(tidy, "edges")
    seen = _print(tidy)
    while seen[0]:
        tidy = ws.written(_small_star(_large_star(tidy).filter("u <> v").distinct()).distinct(), "edges")
        now = _print(tidy)
        if now == seen:
            break
        seen = now
    return tidy.select(F.col("u").alias("node"), F.col("v").alias("component"))
