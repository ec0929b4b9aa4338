"""Connected components of an edge list, by alternating star operations.

Each round is joins and min-aggregations, with no list of neighbours anywhere, so a hub with
a third of all edges combines map-side or is split by a skew join. Every round is written to
the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of a node to the least of its neighbourhood. Small star: the others and itself."""
    if large:
        directed = _both_ways(edges)
        least = directed.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = directed.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: bigint) to (id, component), component being the least id; nodes without edges are left out."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        seen = mark
        now = cut(_star(_star(now, True), False))
    pairs = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return pairs.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
