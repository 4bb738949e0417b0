"""Scans along ordered rows of large groups: by ranges of rows, with what one range hands on to the next.

A window over a whole file would hold it in one task. Here a group falls into ranges of ``width`` row numbers; each range
is scanned alone, and one row a range (its last value, its count) is scanned per group to carry over the borders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

c = F.col
#: Row numbers in a range.
WIDTH = 100_000


def agree(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Whether both sides have the same keys, nulls included."""
    return reduce(lambda x, y: x & y, (left[k].eqNullSafe(right[k]) for k in keys))


def with_group(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of the table's row for their keys, nulls included; the table has a row a group."""
    right = table.select(*(c(k).alias(f"__of_{k}") for k in keys), *(x for x in table.columns if x not in keys))
    same = reduce(lambda x, y: x & y, (c(k).eqNullSafe(c(f"__of_{k}")) for k in keys))
    return rows.join(right, same, "left").drop(*(f"__of_{k}" for k in keys))


def last_value(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the last value that is not null at or above each row of its group."""
    d = rows.withColumns({"__value": value, "__range": F.floor(c(order) / width)})
    part = [*keys, "__range"]
    near = F.last("__value", ignorenulls=True).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ends = d.groupBy(*part).agg(F.max_by("__value", F.when(c("__value").isNotNull(), c(order))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    out = with_group(d.withColumn("__near", near), carried, part)
    return out.withColumn(name, F.coalesce("__near", "__carried")).drop("__value", "__range", "__near", "__carried")


def runs(rows: DataFrame, keys: list[str], order: str, gap: int, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the number, from 1, of the run of their group that they are in; more than gap missing numbers part two runs."""
    d = rows.withColumn("__range", F.floor(c(order) / width))
    part = [*keys, "__range"]
    near = Window.partitionBy(*part).orderBy(order)
    new = F.coalesce(c(order) - F.lag(order).over(near) > gap + 1, F.lit(False)).cast("int")
    d = d.withColumn("__new", new).withColumn("__in", F.sum("__new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    ends = d.groupBy(*part).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"), F.sum("__new").alias("__more"))
    along = Window.partitionBy(*keys).orderBy("__range")  # a row a range
    starts = F.coalesce(c("__lo") - F.lag("__hi").over(along) > gap + 1, F.lit(True)).cast("int")
    ends = ends.withColumn("__starts", starts)
    ends = ends.withColumn("__base", F.sum(c("__starts") + c("__more")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - c("__more"))
    out = with_group(d, ends.select(*part, "__base"), part)
    return out.withColumn(name, c("__base") + c("__in")).drop("__range", "__new", "__in", "__base")


def numbered(rows: DataFrame, keys: list[str], first: list[str], last: str, name: str, ids: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """rows with their number, from 1, within the group of their keys, in order of the columns first and then the number last.

    Rows of equal first columns are numbered by ranges of ``width`` of last, and a row a range hands on how many stand before it.
    ids: the same rows with only these columns, where those are cheaper to read. Keys and order are not null.
    """
    part = [*keys, *first, "__range"]
    ranged = lambda d: d.withColumn("__range", F.floor(c(last) / width))
    before = Window.partitionBy(*keys).orderBy(*first, "__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = ranged(rows if ids is None else ids).groupBy(*part).agg(F.count("*").alias("__n"))
    bases = bases.select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    near = F.row_number().over(Window.partitionBy(*part).orderBy(last))
    return ranged(rows).join(bases, part).withColumn(name, (c("__base") + near).cast("int")).drop("__range", "__base")


def first_rows(rows: DataFrame, keys: list[str], order: str, n: int, width: int = 4096) -> DataFrame:
    """The first n rows of each group by the number order, with their place k from 1.

    Rows are counted by ranges of ``width``; only those of the ranges that hold the first n are sorted. rows are read twice.
    """
    part = [*keys, "__range"]
    d = rows.withColumn("__range", F.floor(c(order) / width))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counted = d.groupBy(*part).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    ends = counted.where(c("__before") < n).groupBy(*keys).agg(F.max("__range").alias("__end"))
    near = with_group(d, saved(ends, "ends"), keys).where("__range <= __end").drop("__range", "__end")
    return near.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(c("k") <= n)
