"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkolat.lineage import written


def star_step(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), v < u, each once. Large: every larger neighbour of a node is linked to the node's least neighbour; small:
    every smaller one and the node. A hub's rows meet only in a partial minimum and a join that Spark can split."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("m", "u").alias("m"))
        out = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        linked = edges.join(least, F.col("u") == F.col("n"))
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges(a, b), the component being its smallest node. Each round is written, so that a
    lost executor costs at most the round. Rounds end when the edges no longer change: every node then points at its root."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "cc")
    mark = None
    for _ in range(max_rounds):
        now = written(star_step(star_step(now, True), False), "cc")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = new
    raise RuntimeError(f"components still change after {max_rounds} rounds")
