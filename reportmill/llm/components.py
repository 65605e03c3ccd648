"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each round is two aggregations and two joins over the edges and writes its edges to the shared
folder, so lineage stays short and a lost executor costs a part of a round. The number of rounds grows
with the logarithm of the longest path. Nothing but two numbers a round goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import materialize, release


def _join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """An inner join on a key and its hash: both sides are dealt anew, so Spark can split a hot key's rows."""
    salted = lambda d: d.withColumn("key_hash", F.xxhash64(on))
    return salted(left).join(salted(right), [on, "key_hash"]).drop("key_hash")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component."""
    low, high = F.least(a, b), F.greatest(a, b)
    now = edges.where(F.col(a) != F.col(b)).select(high.alias("a"), low.alias("b")).distinct()
    now, mark = materialize(now, "edges"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = seen
        ends = now.select(F.col("b").alias("b"), F.col("a").alias("v")).unionByName(now.select(F.col("a").alias("b"), F.col("b").alias("v")))
        least = ends.groupBy("b").agg(F.min("v").alias("m")).select("b", F.least("b", "m").alias("m"))
        large = _join(now, least, "b").select("a", F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _join(large, least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(before)
