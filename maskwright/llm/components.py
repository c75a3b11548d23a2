"""Connected components of an edge table, by large-star and small-star steps, without any edge on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import discard, written


def _smallest(pairs: DataFrame) -> DataFrame:
    """u, v, m: m is the smallest of u and its neighbours. The sides of the join have different keys, so that both are
    shuffled for it and a node with very many neighbours is split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), F.xxhash64("u").alias("h"))
    return pairs.withColumn("h", F.xxhash64("u")).join(least, "h").filter("u = w").select("u", "v", "m")


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    many = edges.groupBy("u").agg(F.count("*").alias("n"))
    if not many.filter("n > 1").isEmpty():
        return False
    return edges.select(F.col("v").alias("u")).distinct().join(many, "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for each node of edges (u, v). Null nodes are left out."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = written(now, "edges")
    while not _stars(now):
        before = now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        small = _smallest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = written(small, "edges")
        discard(before, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
