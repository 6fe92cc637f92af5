"""Connected components of an edge list, by alternating large and small stars.

Each step replaces edges by edges to a node's smallest neighbour, so the list never grows beyond its
first size. Minima are aggregated before the shuffle, so a hub costs one row per task; no node's
neighbours are gathered. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigsense.llm.base import stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link a node's larger (large star) or not larger (small star) neighbours to the smallest of node and neighbours."""
    around = _both(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = around.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) to (node, root): root is the smallest node of the component, for nodes other than roots."""
    now = stage(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "edges")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    seen = mark(now)
    while seen["n"]:
        now = stage(_star(_star(now, large=True), large=False), "edges")
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
