"""Exact medians of large groups by counting.

An exact percentile keeps all distinct values of a group in one task. Here the range of a group that holds its middle
values is cut into bins, counted, and replaced by the bin with the middle, with the least and largest value in it, until
few values are left; then these are counted one by one. Bins are counted before the shuffle, and rows of one group meet
the bounds of their range in SPREAD parts, so a group with a third of all rows spreads.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

c = F.col
BINS, FEW, SPREAD = 1 << 12, 10_000, 16


def medians(rows: DataFrame, keys: list[str], value: Column, name: str = "median", bins: int = BINS, few: int = FEW) -> DataFrame:
    """(*keys, name): the mean of the two middle values of each group, the middle one of an odd number.

    Nulls and NaNs do not count, infinities stand for the largest number; a group without other values has no row. Keys may be null. An empty table gives an empty
    result. Each round reads a written copy of the values; a round divides the middle range by ``bins``, so few are needed.
    """
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    x = rows.select(group.alias("g"), F.greatest(F.lit(-sys.float_info.max), F.least(F.lit(sys.float_info.max), value.cast("double"))).alias("x"), value.alias("raw"))
    x = x.where("raw IS NOT NULL AND NOT isnan(raw)").drop("raw")
    x = saved(x.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(SPREAD))), "values")
    n = x.groupBy("g").agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # place: which of the middle values; rank: its number from 0 among the m values from lo to hi.
    middle = F.array(F.expr("(m - 1) DIV 2"), F.expr("m DIV 2"))
    sought = saved(n.select("g", "m", "lo", "hi", F.posexplode(middle).alias("place", "rank")), "sought")
    while not sought.where(f"lo < hi AND m > {few}").isEmpty():
        wide = sought.where(f"lo < hi AND m > {few}")
        share = (c("x") / 2 - c("lo") / 2) / (c("hi") / 2 - c("lo") / 2)  # halves do not overflow
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
        counted = _inside(x, wide).groupBy("g", "place", "rank", bin_.alias("bin")).agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        sought = saved(sought.where(f"lo = hi OR m <= {few}").unionByName(_at_rank(counted, "bin")), "sought")
    # Few values, or few distinct ones, are left of each group.
    rest = _inside(x, sought.where("lo < hi")).groupBy("g", "place", "rank", "x").agg(F.count("*").alias("m"))
    found = sought.where("lo = hi").select("g", "place", c("lo").alias("x")).unionByName(_at_rank(rest, "x").select("g", "place", "x"))
    out = found.groupBy("g").agg(F.avg("x").alias(name))
    return out.select("g.*", name) if keys else out.select(name)


def _inside(x: DataFrame, sought: DataFrame) -> DataFrame:
    """Values in the ranges sought of their group."""
    bounds = sought.select(c("g").alias("h"), "place", "rank", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("p"))
    met = x.join(bounds, x["g"].eqNullSafe(bounds["h"]) & (x["part"] == bounds["p"]) & x["x"].between(bounds["lo"], bounds["hi"]))
    return met.drop("h", "p", "part")


def _at_rank(counted: DataFrame, order: str) -> DataFrame:
    """Of each group's counted bins the one that holds the rank, and the rank within it."""
    upto = F.sum("m").over(Window.partitionBy("g", "place").orderBy(order))
    d = counted.withColumn("upto", upto).where("upto > rank AND upto - m <= rank")
    return d.withColumn("rank", c("rank") - (c("upto") - c("m"))).drop("upto", *(["bin"] if order == "bin" else []))
