"""Connected components of an edge table, distributed: alternating large-star and small-star rounds.

Each round is written to the shared folder, so a round survives lost executors and the plan stays short. Rows of a hot centre meet
only in partial aggregates and in joins of two plain exchanges, which Spark splits when they are skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, list[str]]:
    """edges(u, v) with u > v. Large star: every larger neighbour moves to the least neighbour; small star: u and every smaller one do."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least, path = written(least, "least")
    if large:
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out, done = written(moved.filter("u <> v").distinct(), "star")
    discard(edges.sparkSession, path)
    return out, [done]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label for every node of edges(a, b): the label is the least node reachable. Nodes must be longs without nulls."""
    spark = edges.sparkSession
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = written(edges, "edges")
    held = [path]
    sign = None
    for _ in range(most_rounds):
        for large in (True, False):
            edges, paths = _star(edges, large)
            discard(spark, *held)
            held = paths
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Once nothing moves, each node but a least one has a single edge, to the least node of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
