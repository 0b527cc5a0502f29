"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge its component's smallest node.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest node it knows (large and
    small star). Rounds grow with the logarithm of the longest path; each is written to the shared folder, so a lost
    executor costs one round. A hub is a key of the joins only, and each round sends a row an edge at most."""
    now = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(), "edges")
    before, mark = None, _mark(now)
    while mark[0] and mark != before:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least("v", F.min("u")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        now = materialise(small, "edges")
        before, mark = mark, _mark(now)
    roots = now.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them: equal when a round changed nothing."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return row[0], row[1]
