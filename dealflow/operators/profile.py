"""Stacked tabs and column profiles (C1 to C5), and monetary scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import MONETARY, PROFILE_BLANKS, UNITS
from .medians import medians
from .segments import first_rows

c = F.col


def stacked(tabs: dict[str, DataFrame]) -> DataFrame:
    """Tabs of one schema, one below the other by column name, with the label of each."""
    parts = [d.withColumn("fund_tab", F.lit(label)) for label, d in tabs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fund_labels(tabs: DataFrame) -> DataFrame:
    """(file, sheet, fund_label): tab names without the trailing segments that all tabs of a file share."""
    d = tabs.withColumn("seg", F.filter(F.split(F.trim("sheet"), r"\s*[-–—|:]\s*"), lambda x: x != ""))
    d = d.withColumn("rev", F.reverse("seg"))
    per = d.groupBy("file").agg(F.count("*").alias("n"), F.min(F.size("seg")).alias("least"), F.collect_set("rev").alias("all"))  # tabs of one file
    first = F.element_at("all", 1)
    # Number of leading reversed segments in which every tab agrees with the first, one segment at least is left.
    agree = lambda k: F.forall("all", lambda a: F.slice(a, 1, k) == F.slice(first, 1, k))
    ks = F.when((c("n") >= 2) & (c("least") > 1), F.sequence(F.lit(1), c("least") - 1)).otherwise(F.array().cast("array<int>"))
    common = F.aggregate(ks, F.lit(0), lambda a, k: F.when((a == k - 1) & agree(k), k).otherwise(a))
    d = d.join(per.withColumn("common", common).select("file", "common"), "file")
    kept = F.slice("seg", F.lit(1), F.greatest(F.size("seg") - c("common"), F.lit(0)))
    label = F.array_join(F.when(F.size("seg") > c("common"), kept).otherwise(c("seg")), " - ")
    return d.select("file", "sheet", F.when(label == "", F.trim("sheet")).otherwise(label).alias("fund_label"))


def unit(header: Column) -> Column:
    """The unit in a header, by the first pattern that matches."""
    return F.coalesce(*(F.when(header.rlike(f"(?i){p}"), u) for p, u in UNITS))


def _begins_a_word(v: Column) -> Column:
    """Whether text starts with a letter that starts no number, as those of inf and nan do; a cast that fails is slow."""
    code = F.ascii(v)
    return (code.between(ord("A"), ord("Z")) | code.between(ord("a"), ord("z"))) & ~code.isin(*map(ord, "INin"))


def column_profiles(cells: DataFrame) -> DataFrame:
    """A profile of each column from text cells (file, col_index, col_name, row_no, value); nulls are blanks.

    A date is text that starts yyyy-mm-dd. The samples are the first ten values. cells are read several times.
    """
    v = F.trim("value")
    d = cells.withColumns({"v": F.when(~v.isin(*PROFILE_BLANKS), v)})
    d = d.withColumn("is_date", c("v").rlike(r"^\d{4}-\d{2}-\d{2}")).withColumn("num", F.when(~c("is_date") & ~_begins_a_word(c("v")), F.nanvl(c("v").try_cast("double"), F.lit(None).cast("double"))))
    share = lambda cond: F.avg(F.when(c("num").isNotNull(), cond.cast("double")))
    g = d.groupBy("file", "col_index", "col_name").agg(
        F.count("*").alias("rows"), F.count("v").alias("n"), F.avg(c("is_date").cast("double")).alias("dates"), F.count("num").alias("numbers"),
        F.min("num").alias("lo"), F.max("num").alias("hi"), F.avg("num").alias("mean"), F.avg(F.length("v")).alias("length"),
        share(F.abs("num") <= 2).alias("small"), F.avg(c("v").contains("%").cast("double")).alias("percents"),
        share((c("num") > 0) & (c("num") < 30)).alias("m1"), share((c("num") >= 0.5) & (c("num") <= 15)).alias("m2"),
        share((c("num") > -0.9) & (c("num") < 3)).alias("i1"), share((c("num") > -90) & (c("num") < 300)).alias("i2"), share(c("num") >= 0.1).alias("c1"),
    )
    # Distinct values are shuffled without the aggregates, and only the rows that hold the samples are sorted.
    different = d.where("v IS NOT NULL").select("file", "col_index", "col_name", "v").distinct().groupBy("file", "col_index", "col_name").agg(F.count("*").alias("distinct"))
    first = first_rows(d.where("v IS NOT NULL").select("file", "col_index", "col_name", "row_no", "v"), ["file", "col_index", "col_name"], "row_no", 10)
    first = first.groupBy("file", "col_index", "col_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("samples"))
    nf = c("numbers") / c("n")
    g = g.join(different, ["file", "col_index", "col_name"], "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    kind = F.when(c("n") == 0, "empty").when(c("dates") >= 0.5, "date").when((nf >= 0.75) & ((c("small") >= 0.8) | (c("percents") >= 0.3)), "percent").when(nf >= 0.75, "numeric").when(nf >= 0.3, "mixed").otherwise("string")
    g = g.withColumns({"data_type": kind, "fill_rate": c("n") / c("rows"), "unit": unit(c("col_name"))})
    some = c("numbers") >= 3
    no = F.lit(False)
    g = g.withColumns(
        {
            "looks_moic": F.coalesce(some & (c("m1") >= 0.85) & (c("m2") >= 0.6) & (c("mean") > 0.5) & (c("mean") < 20), no),
            "looks_irr": F.coalesce(some & (((c("i1") >= 0.9) & c("data_type").isin("numeric", "mixed") & (c("mean") < 0.5)) | ((c("i2") >= 0.9) & (c("data_type") == "percent"))), no),
            "looks_currency": F.coalesce(some & (c("c1") >= 0.8) & (c("hi") >= 1), no),
            "looks_date": F.coalesce(c("dates") >= 0.5, no),
            "looks_identifier": F.coalesce((c("data_type") == "string") & (c("fill_rate") >= 0.5) & (c("distinct") >= F.least(F.lit(3.0), c("n") * 0.3)) & (c("length") < 60), no),
            "value_min": F.when(some, c("lo")), "value_max": F.when(some, c("hi")), "value_mean": F.when(some, c("mean")),
        }
    )
    keys = ["file", "col_index", "col_name"]
    return g.join(first, keys, "left").select(*keys, "rows", "data_type", "fill_rate", "unit", "distinct", "value_min", "value_max", "value_mean", "samples", "looks_moic", "looks_irr", "looks_currency", "looks_date", "looks_identifier")


def monetary_scale(values: DataFrame, headers: DataFrame, banners: DataFrame) -> DataFrame:
    """G1: (file, field_id, factor) that brings monetary fields to millions; factor 1 is left out.

    values: (file, field_id, value); headers: (file, field_id, col_name); banners: (file, banner) with k, m or null.
    """
    med = medians(values.where(c("field_id").isin(*MONETARY)).withColumn("a", F.abs("value")).where("a > 0"), ["file", "field_id"], c("a"), "m")
    d = med.join(headers, ["file", "field_id"], "left").join(banners, "file", "left").withColumn("hint", unit(c("col_name")))
    top = F.max("m").over(Window.partitionBy("file"))
    d = d.withColumn("regime", F.when(top >= 1e6, "abs").when(top >= 5e4, "k"))
    m = c("m")
    factor = (
        F.when((c("hint") == "k") & (m >= 1e3), 1e-3)
        .when(c("hint").endswith("m") & (m < 5e4), 1.0)
        .when((c("banner") == "k") & (m >= 100) & (m < 1e7), 1e-3)
        .when((c("banner") == "m") & (m < 5e4), 1.0)
        .when(m >= 1e6, 1e-6)
        .when((m >= 1e3) & (c("regime") == "abs"), 1e-6)
        .when((m >= 1e3) & (c("regime") == "k"), 1e-3)
        .otherwise(1.0)
    )
    return d.select("file", "field_id", factor.alias("factor")).where("factor <> 1")


def rescale_notice(scales: DataFrame) -> DataFrame:
    """The fields of each file by what they were divided by."""
    return scales.groupBy("file", F.when(c("factor") < 1e-4, "1e6").otherwise("1e3").alias("divided_by")).agg(F.array_join(F.sort_array(F.collect_set("field_id")), ", ").alias("fields"))
