"""Connected components of a table of edges, by alternating star contraction.

Every round hangs each node's larger neighbours on its smallest one (large star), then
each node's smaller ones (small star). Both are window minima over a shuffle by node, so
no node's neighbours need to fit in memory together, and a few rounds suffice for long
chains. Each round is written to the shared folder, and the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least(F.min("v").over(Window.partitionBy("u")), "u")
    return both.withColumn("m", least).where("v > u").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = F.min("u").over(Window.partitionBy("v"))
    hung = edges.withColumn("m", least)
    moved = hung.where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(hung.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that is not the smallest of its component.

    ``edges`` has two integer columns ``u`` and ``v``; rows with a null or with
    ``u = v`` say nothing, and repeated or reversed rows are one edge.
    """
    smaller_first = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    now = store.written(smaller_first.distinct(), "edges")
    mark = None
    while True:
        before, now = now, store.written(_small_star(_large_star(now)), "edges")
        store.drop(before)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if found == mark:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = found
