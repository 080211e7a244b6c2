"""Connected components of an edge table by alternating large-star and small-star steps.

Minima are taken with map-side combine, so a node with most of the edges costs no
task more than its share; joins on such a node are split by adaptive execution.  Each
round is written to the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowaudit.llm.common import staged


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    return out.where("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a > m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.unionByName(least.select("b", F.col("m").alias("a"))).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another node; root is the smallest
    reachable node.  Loops and repeated edges are allowed."""
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    e = staged(e, "edges")
    seen = _print(e)
    while seen[0]:
        e = staged(_small(_large(e)), "edges")
        now = _print(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
