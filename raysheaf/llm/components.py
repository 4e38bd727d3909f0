"""Connected components of an edge table, by alternating large and small stars.

No task sees a whole component: a large star groups by the larger end, a small star by
node, and both emit as many edges as they read. Every round is written to the shared
folder, which cuts the lineage; the number of rounds grows with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (a, b) with the least of a's neighbours and a itself, by a grouped minimum and a join (which Spark can split)."""
    least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return edges.join(least, "a")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to its root, and no root has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    met = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return not met.agg(F.max((F.col("low") + F.col("top") > 1).cast("int"))).first()[0]


def stars(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge: root is the least node that it reaches."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now = written(now, "edges")
    for _ in range(rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = _with_least(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = written(small.where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
