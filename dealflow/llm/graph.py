"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Parts that the neighbours of one node are dealt to.
PARTS = 256


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (a, b) with m, the least of a and all its neighbours; and (a, m), with repeats.

    A node's edges lie in up to PARTS parts, one of which a task may hold; only the least of each part meets.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS))).repartition("a", "part")  # read twice below
    parts = dealt.groupBy("a", "part").agg(F.min("b").alias("m"))
    low = parts.groupBy("a").agg(F.least(F.min("m"), "a").alias("m"), F.collect_list("part").alias("parts"))
    low = low.select("a", "m", F.explode("parts").alias("part"))
    return dealt.join(low, ["a", "part"]).select("a", "b", "m"), low.select("a", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the least node reachable, for the nodes of edges (a, b), by alternating stars.

    Large-star links each larger neighbour of a node to the least of its neighbourhood, small-star each smaller
    one; both are grouped minima, taken by parts of a neighbourhood, so that none is gathered in a task, and the number
    of rounds grows with the logarithm of the largest component. Every round is written to the shared folder. Loops and nulls are dropped.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = C.saved(edges)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both)[0].where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small, low = _with_least(large)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = C.saved(small.union(low.withColumnRenamed("m", "b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    least = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return least.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
