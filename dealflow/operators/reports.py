"""Segmented reports over the deal list (R0 to R50), in long form: one row for each group, totals included.

A report sums measures over groups, so it gives the same over deals and over cells of a cube (sums of deals by the
report's axes): measured() makes a deal a cell of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

c = F.col
#: Axes of the return and loss cuts, by query name.
CUTS = {
    "R3_sector": "sector", "R4_geography": "geography", "R5_process_type": "process_type", "R6_gp_role": "gp_role", "R7_exit_type": "exit_type",
    "R8_revenue_bucket": "revenue_bucket", "R9_ebitda_bucket": "ebitda_bucket", "R10_multiple_bucket": "multiple_bucket", "R11_entry_ev_bucket": "entry_ev_bucket",
    "R12_vintage": "vintage", "R13_vintage_ic": "vintage", "R14_margin_bucket": "margin_bucket", "R15_ic_bucket": "ic_bucket", "R16_coi": "coi", "R17_fund": "fund",
}
FILTERS = ("fund", "status", "hold_bucket")


#: Sums that reports are made of. deal_count, moic_sum, moic_count, hold_sum and hold_count come from measured().
MEASURES = (
    "deal_count", "moic_sum", "moic_count", "hold_sum", "hold_count", "ic_weight", "total_value", "ic_in_loss", "impaired_value", "realized", "current_value", "total_ic", "ic_for_bucket", "hold_p",
    "rev_cagr_w", "rev_cagr_p", "ebitda_cagr_w", "ebitda_cagr_p", "entry_margin_w", "entry_margin_p", "exit_margin_w", "exit_margin_p", "multiple_w", "entry_multiple_p", "exit_multiple_p", "leverage_w", "entry_leverage_p", "exit_leverage_p",
)


def measured(deals: DataFrame) -> DataFrame:
    """deals with a count of one and with parts of means; cells of a cube as they are."""
    if "deal_count" in deals.columns:
        return deals
    parts = {"moic": "gross_moic", "hold": "hold_period"}
    mean = {f"{k}_sum": c(x).cast("double") for k, x in parts.items() if x in deals.columns} | {f"{k}_count": c(x).isNotNull().cast("long") for k, x in parts.items() if x in deals.columns}
    return deals.withColumns({"deal_count": F.lit(1).cast("long"), **mean})


DEALS = "deal_count"


def _count() -> Column:
    return F.coalesce(F.sum(DEALS), F.lit(0)).alias("deals")


def _mean(of: str) -> Column:
    return F.try_divide(F.sum(f"{of}_sum"), F.sum(f"{of}_count"))


def cube(deals: DataFrame, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """The sums of MEASURES of each set of axes, all in one pass over the deals: (cube, *axes, *measures).

    Sums of decimals are exact, so a report over cells equals that over deals. An axis that is not in a set is null
    in its cells.
    """
    axes = list(dict.fromkeys(a for s in sets.values() for a in s))
    have = [m for m in MEASURES if m in measured(deals).columns]
    rows = measured(deals).select(*axes, *have)
    out = rows.groupingSets([list(s) for s in dict.fromkeys(sets.values())], *axes).agg(F.grouping_id().alias("gid"), *(F.sum(m).alias(m) for m in have))
    name = None
    for s in dict.fromkeys(sets.values()):
        mask = sum(1 << (len(axes) - 1 - i) for i, a in enumerate(axes) if a not in s)
        name = F.when(c("gid") == mask, ",".join(s)) if name is None else name.when(c("gid") == mask, ",".join(s))
    return out.withColumn("cube", name).select("cube", *axes, *have)


def pooled() -> list[Column]:
    """Count, sums, multiple, loss ratio and impaired ratio; a ratio of sums is null where nothing is invested."""
    ic = F.sum("ic_weight")
    return [
        _count(),
        ic.cast("decimal(24,7)").alias("ic"),
        S.rounded(S.divide(F.sum(F.coalesce("total_value", F.lit(0))), ic), 6).alias("moic"),
        S.rounded(S.divide(F.sum("ic_in_loss"), ic), 6).alias("loss_ratio"),
        S.rounded(S.divide(F.sum("impaired_value"), ic), 6).alias("impaired_ratio"),
    ]


def filtered(deals: DataFrame, axis: str | None = None, **wanted) -> DataFrame:
    """R2: rows whose filter columns are among the wanted values; a filter on the axis itself is dropped."""
    for col, values in wanted.items():
        if col != axis and values is not None:
            deals = deals.where(c(col).isin(*values))
    return deals


def _axis(axis: str) -> Column:
    """Years show n/a where missing; other axes hide blanks."""
    return F.coalesce(c(axis).cast("string"), F.lit("n/a")) if axis in ("vintage", "exit_year") else c(axis).cast("string")


def cut(deals: DataFrame, axis: str, **wanted) -> DataFrame:
    """The pooled statistics of each visible item of an axis, and of all visible deals (is_total 1)."""
    rows = filtered(measured(deals), axis, **wanted).withColumn("item", _axis(axis)).where("item IS NOT NULL")
    return rows.rollup("item").agg(F.grouping("item").cast("int").alias("is_total"), *pooled()).select("is_total", "item", "deals", "ic", "moic", "loss_ratio", "impaired_ratio")


def all_cuts(deals: DataFrame, axes: tuple[str, ...] = tuple(dict.fromkeys(CUTS.values()))) -> DataFrame:
    """Every cut in one pass over the deals, by grouping sets; one row for each axis and visible item."""
    rows = measured(deals).select(*(_axis(a).alias(a) for a in axes), DEALS, "ic_weight", "total_value", "ic_in_loss", "impaired_value")
    out = rows.groupingSets([[a] for a in axes], *axes).agg(F.grouping_id().alias("gid"), *pooled())
    name, item = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, a in enumerate(axes):
        # In a set of one axis, the bits of all others are set.
        mine = c("gid") == (1 << len(axes)) - 1 - (1 << (len(axes) - 1 - i))
        name, item = F.when(mine, a).otherwise(name), F.when(mine, c(a)).otherwise(item)
    return out.select(name.alias("axis"), item.alias("item"), "deals", "ic", "moic", "loss_ratio", "impaired_ratio").where("item IS NOT NULL")


def dispersion(deals: DataFrame, by: str) -> DataFrame:
    """Deals, share of invested capital and average multiple of each bucket, with a total."""
    rows = measured(deals).where(c(by).isNotNull())
    out = rows.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), _count(), F.sum("ic_weight").alias("s"), _mean("moic").alias("m"))
    whole = F.max(F.when(c("is_total") == 1, c("s"))).over(Window.partitionBy())  # after grouping: a row a bucket
    return out.select("is_total", c(by).alias("item"), "deals", S.rounded(S.divide(c("s"), whole), 6).alias("ic_share"), S.rounded(c("m"), 4).alias("avg_moic"))


def share_matrix(deals: DataFrame, rows: str, cols: str, value: str = "ic_weight", of: str = "row", hide_blank: bool = True) -> DataFrame:
    """Sums of value by row and column as a share of their row, or column, and a grand row."""
    d = deals.withColumns({"r": _axis(rows), "k": _axis(cols)})
    d = d.where("r IS NOT NULL AND k IS NOT NULL") if hide_blank else d
    d = d.groupBy("r", "k").agg(F.sum(value).alias("s"))
    grand = d.groupBy("k").agg(F.sum("s").alias("s")).select(F.lit(1).alias("is_grand"), F.lit(None).cast("string").alias("r"), "k", "s")
    d = d.select(F.lit(0).alias("is_grand"), "r", "k", "s").union(grand)
    w = Window.partitionBy("is_grand", "r") if of == "row" else Window.partitionBy("is_grand", "k")
    return d.select("is_grand", c("r").alias("row_item"), c("k").alias("col_item"), c("s").cast("decimal(24,7)").alias("amount"), S.rounded(S.divide(c("s"), F.sum("s").over(w)), 6).alias("share"))


def counts(deals: DataFrame, axis: str) -> DataFrame:
    """Deals of each visible item and in all, with the place by descending count."""
    out = measured(deals).where(c(axis).isNotNull()).rollup(axis).agg(F.grouping(axis).cast("int").alias("is_total"), _count())
    w = Window.partitionBy("is_total").orderBy(F.desc("deals"), axis)
    return out.select("is_total", c(axis).alias("item"), "deals", F.row_number().over(w).alias("place"))


def matrix(deals: DataFrame, rows: str, cols: str) -> DataFrame:
    """Count and pooled multiple by row and column, with totals of both and of all visible deals."""
    d = measured(deals).withColumns({"r": _axis(rows), "k": _axis(cols)}).where("r IS NOT NULL AND k IS NOT NULL")
    out = d.cube("r", "k").agg(F.grouping("r").cast("int").alias("all_rows"), F.grouping("k").cast("int").alias("all_cols"), *pooled())
    return out.select("all_rows", "all_cols", c("r").alias("row_item"), c("k").alias("col_item"), "deals", "moic")


def matrix_counts(deals: DataFrame, rows: str, cols: str) -> DataFrame:
    """Deals by row and column."""
    d = measured(deals).withColumns({"r": _axis(rows), "k": _axis(cols)}).where("r IS NOT NULL AND k IS NOT NULL")
    return d.groupBy(c("r").alias("row_item"), c("k").alias("col_item")).agg(_count())


def underperforming(deals: DataFrame) -> DataFrame:
    """Deals in loss by fund and company, with totals."""
    d = measured(deals).where("performing = 1 AND fund IS NOT NULL AND company IS NOT NULL")
    return d.rollup("fund", "company").agg(
        F.grouping_id().cast("int").alias("level"), _count().alias("loss_deals"), S.rounded(S.divide(F.sum("total_value"), F.sum("ic_weight")), 6).alias("moic"),
        F.sum(F.coalesce("current_value", F.lit(0))).cast("decimal(24,7)").alias("current_value"), S.rounded(S.divide(F.sum("impaired_value"), F.sum("ic_weight")), 6).alias("impaired_ratio"), S.rounded(_mean("hold"), 4).alias("avg_hold"),
    ).select("level", "fund", "company", "loss_deals", "moic", "current_value", "impaired_ratio", "avg_hold")


def partner_attribution(deals: DataFrame) -> DataFrame:
    """Cut by sourcing partner, placed without regard to case."""
    out = cut(deals, "sourcing_partner")
    return out.select("is_total", "item", "deals", "moic", F.row_number().over(Window.partitionBy("is_total").orderBy(F.lower("item"))).alias("place"))


#: (weight, product) of each metric.
METRICS = {
    "growth": {"rev_cagr": ("rev_cagr_w", "rev_cagr_p"), "ebitda_cagr": ("ebitda_cagr_w", "ebitda_cagr_p")},
    "margins": {"entry_margin": ("entry_margin_w", "entry_margin_p"), "exit_margin": ("exit_margin_w", "exit_margin_p")},
    "multiples": {"entry_multiple": ("multiple_w", "entry_multiple_p"), "exit_multiple": ("multiple_w", "exit_multiple_p")},
    "leverage": {"entry_leverage": ("leverage_w", "entry_leverage_p"), "exit_leverage": ("leverage_w", "exit_leverage_p")},
}


def operating_by_fund(deals: DataFrame, kind: str, status: str | None = None) -> DataFrame:
    """Weighted means of a kind's metrics by fund, with a total of the visible funds."""
    d = filtered(deals, status=(status,) if status else None).where("fund IS NOT NULL")
    cols = [S.rounded(S.divide(F.sum(p), F.sum(w)), 6).alias(m) for m, (w, p) in METRICS[kind].items()]
    return d.rollup("fund").agg(F.grouping("fund").cast("int").alias("is_total"), *cols).select("is_total", "fund", *METRICS[kind])


def realized_by_fund(deals: DataFrame) -> DataFrame:
    """Realized and current value by fund, and the share that is unrealized."""
    d = deals.where("fund IS NOT NULL").rollup("fund").agg(F.grouping("fund").cast("int").alias("is_total"), F.sum("realized").cast("decimal(24,7)").alias("realized"), F.sum(F.coalesce("current_value", F.lit(0))).cast("decimal(24,7)").alias("current_value"))
    return d.withColumn("unrealized_share", S.rounded(S.divide(c("current_value"), c("realized") + c("current_value")), 6))


def hold_by_fund(deals: DataFrame, status: str = "Unrealized") -> DataFrame:
    """Hold period weighted by invested capital; products over all, weights over total_ic."""
    d = deals.where((c("status") == status) & c("fund").isNotNull())
    return d.rollup("fund").agg(F.grouping("fund").cast("int").alias("is_total"), S.rounded(S.divide(F.sum("hold_p"), F.sum("total_ic")), 6).alias("weighted_hold"))


def chart_series(report: DataFrame, bar: str, line: str, hide_missing: bool = False) -> DataFrame:
    """Label of item and count, bar and line of a report's items; dispersion charts leave n/a out."""
    d = report.where("is_total = 0")
    d = d.where("item <> 'n/a'") if hide_missing else d
    return d.select(F.concat_ws("\n", "item", c("deals").cast("string")).alias("label"), c(bar).alias("bar"), c(line).alias("line"))


#: Axes whose items stand in the order of their buckets, and axes of numbers.
BUCKETED = {
    "hold_bucket": "hold", "ic_bucket": "ic", "moic_bucket": "moic", "irr_bucket": "irr", "ebitda_bucket": "ebitda", "revenue_bucket": "revenue", "entry_ev_bucket": "entry_ev",
    "multiple_bucket": "entry_multiple", "margin_bucket": "entry_margin",
}
YEARS = ("vintage", "exit_year")
ITEM_CHARS = 255


def axis_items(deals: DataFrame, axes: tuple[str, ...], seen: str = "deal_id") -> DataFrame:
    """(axis, place, item): the distinct items of each axis in the order in which reports list them.

    Buckets stand in canonical order, numbers ascend and text follows in order, other items stand as first seen (by
    the column seen). Blank items are none; text is cut at 255 characters. All axes are counted in one pass.
    """
    text = lambda a: F.substring(F.trim(c(a).cast("string")), 1, ITEM_CHARS)
    rows = deals.select(seen, F.inline(F.array(*(F.struct(F.lit(a).alias("axis"), text(a).alias("item")) for a in axes)))).where("item <> ''")
    d = rows.groupBy("axis", "item").agg(F.min(seen).alias("first"))
    known, year = F.lit(None).cast("int"), c("axis").isin(*YEARS)
    for a in axes:
        if a in BUCKETED:
            known = F.when(c("axis") == a, F.nullif(F.array_position(F.array(*map(F.lit, S.bucket_labels(BUCKETED[a]))), c("item")).cast("int"), F.lit(0))).otherwise(known)
    number = F.when(year, c("item").try_cast("long"))
    order = [F.coalesce(known, F.lit(1000)), F.asc_nulls_last(number), F.when(year, c("item")), F.when(~year, c("first")), "item"]
    return d.select("axis", F.row_number().over(Window.partitionBy("axis").orderBy(*order)).alias("place"), "item")  # distinct items of one axis


def deal_count(deals: DataFrame) -> DataFrame:
    """R28."""
    return measured(deals).agg(_count())


def write_reports(deals: DataFrame, reports: dict, axes: dict[str, tuple[str, ...]], folder: str) -> DataFrame:
    """A10: writes every report into a folder of its own; (report, name, value, n): how often each value stands in a column.

    reports: name to a function of deals or cells; axes: the axes that each reads. The deals are read once, for the
    cube; it is stored by its sets of axes, and each report reads the cells of its own. Numbers are given with seven places.
    """
    spark = deals.sparkSession
    cube(deals, axes).write.partitionBy("cube").parquet(f"{folder}/cube")
    cells, out = spark.read.option("basePath", f"{folder}/cube"), None
    schema = cells.parquet(f"{folder}/cube").schema
    for name, run in reports.items():
        of = ",".join(axes[name])
        run(cells.schema(schema).parquet(f"{folder}/cube").where(c("cube") == of).select(*axes[name], *(m for m in MEASURES if m in schema.names))).write.parquet(f"{folder}/{name}")
        got = spark.read.parquet(f"{folder}/{name}")
        text = lambda x: F.coalesce(F.coalesce(c(x).cast("string").try_cast("decimal(38,7)").cast("string"), c(x).cast("string")), F.lit("null"))
        long = got.select(F.inline(F.array(*(F.struct(F.lit(name).alias("report"), F.lit(x).alias("name"), text(x).alias("value")) for x in got.columns))))
        out = long if out is None else out.unionByName(long)
    return out.groupBy("report", "name", "value").agg(F.count("*").alias("n"))
