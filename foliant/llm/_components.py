"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foliant.llm._common import BROADCAST_IDS, Stage


def _moved(stage: Stage, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, m: the edges with the least b of each a, and the table of node, m.

    The least neighbours are written first: a join with the aggregate itself
    would keep its partitioning, and all edges of a hub in one task. So the
    join is a broadcast or one that adaptive execution splits.
    """
    least = stage.put(edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node"))
    return edges.join(stage.small(least), F.col("a") == F.col("node")).select("a", "b", "m"), least


def large_star(stage: Stage, edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours. edges: a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved, _ = _moved(stage, both)
    return moved.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a > b")


def small_star(stage: Stage, edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. edges: a > b."""
    moved, least = _moved(stage, edges)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("node", "m")).where("a > b").distinct()


def connected(stage: Stage, links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of a link. links: a, b (any order, no nulls).

    Each round is written to the shared folder; it ends when the edges, which
    are stars then, no longer change (same count and sum of hashes).
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        """df written, with the count and the hash sum that the writing itself has seen."""
        seen = Observation()
        out = stage.put(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
        return out, (seen.get.get("n", 0), seen.get.get("sum"))

    edges, last = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while last[0]:
        large = large_star(stage, edges)
        if stage.rows(edges) > BROADCAST_IDS:  # it is read twice, and costs a shuffle then
            large = stage.put(large)
        new, now = written(small_star(stage, large))
        stage.drop(edges, large)
        edges = new
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct().toDF("node", "component"))
