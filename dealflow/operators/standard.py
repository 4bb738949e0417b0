"""Rows of matched tables as standard deals: values by field, scaled, parsed and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.catalog import MONETARY
from ..sources.shared import saved

c = F.col
TEXT = ("company", "fund", "sector", "region", "status")
DATES = ("entry_date", "exit_date")
RATIOS = ("gross_moic", "gross_irr")


def typed_rows(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """rows (file, ..., vals) with typed columns in place of the map: company, fund, status, dates, ratios, and money unscaled.

    mapped: (file, field_id, col_name). Text is read here alone; written once, the result serves the scales and
    standard_rows(). Numbers and dates are read in arrays: an expression for each field, side by side, makes a method
    that is too long for the JVM to compile.
    """
    per = mapped.where("col_name IS NOT NULL").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field_id", "col_name"))).alias("m"))  # 33 fields at most
    parts = {"__texts": (TEXT, lambda x: x), "__dates": (DATES, S.to_date), "__numbers": ((*RATIOS, *MONETARY), S.to_number)}
    per = per.select("file", *(F.array(*(F.element_at("m", f) for f in fields)).alias(part) for part, (fields, _) in parts.items()))
    values = lambda part, read: F.transform(part, lambda h: read(F.element_at("vals", h)))
    d = rows.join(per, "file").withColumns({part: values(part, read) for part, (_, read) in parts.items()})
    d = d.withColumns({f: F.get(part, F.lit(i)) for part, (fields, _) in parts.items() for i, f in enumerate(fields)})
    own = F.coalesce(F.trim("fund"), c("fund_label") if "fund_label" in rows.columns else F.lit(None))
    return d.withColumns({"company": F.trim("company"), "fund": own, "status": S.normalise_status(c("status"))}).drop("vals", "fund_label", *parts)


def monetary_values(rows: DataFrame) -> DataFrame:
    """(file, field_id, value) of the monetary fields of typed rows, for the scales."""
    return rows.select("file", F.inline(F.array(*(F.struct(F.lit(f).alias("field_id"), c(f).alias("value")) for f in MONETARY)))).where("value IS NOT NULL")


def standard_rows(rows: DataFrame, scales: DataFrame, funds: DataFrame) -> DataFrame:
    """Typed rows with money times the factor of its file and field, and no company that is a fund.

    scales: (file, field_id, factor), fields without one stay; funds: (file, fund), names that are no company. Both are
    short and written, so that Spark knows it: a join by file that shuffles rows holds a file in one task.
    """
    per = saved(scales.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field_id", "factor"))).alias("factors")))  # the monetary fields at most
    names = saved(funds.select(c("file").alias("__file"), F.trim("fund").alias("__fund")).where("__fund <> ''").distinct())
    d = rows.join(per, "file", "left").join(names, (c("file") == c("__file")) & (c("company") == c("__fund")), "left")
    out = {"company": S.company_not_fund(c("company"), F.array("__fund", "fund"))} | {f: S.scaled(c(f), F.element_at("factors", f)) for f in MONETARY}
    return d.withColumns(out).drop("factors", "__file", "__fund")


def input_rows(grid: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Rows of deal-input grids (file_id, row_no, header, value) as text columns by file and row_no; headers: column to its header, without regard to case."""
    rows = grid.groupBy(c("file_id").alias("file"), "row_no").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("header"), "value"))).alias("m"))  # the cells of one row
    return rows.select("file", "row_no", *(F.element_at("m", h.lower()).alias(x) for x, h in headers.items()))
