"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links between node numbers to ``(node, root)``, root being the smallest node reached.

    Alternating star contraction: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it sees, until all links end in a root. Each round is a few shuffles of the links that
    are left, written to the shared folder; rounds grow with the logarithm of the longest path. Nodes
    without links are absent. No links give no rows.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
        if inner.isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.withColumn("root", F.col("node"))
    )
