"""Data quality: field, row and table rules (V1 to V18, U1) and the publish gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

c = F.col


@dataclass(frozen=True)
class Rule:
    """A check of one or several columns; valid holds for good values, nulls pass."""

    field: str
    valid: Column
    severity: str
    message: str
    kind: str = "field"


def default_rules() -> list[Rule]:
    """V1-V12."""
    num = lambda x: c(x).cast("double")
    return [
        Rule("gross_moic", num("gross_moic") > 0, "error", "MOIC must be positive"),
        Rule("gross_moic", num("gross_moic") < 100, "warning", "MOIC > 100x is highly unusual"),
        Rule("gross_irr", (num("gross_irr") > -1) & (num("gross_irr") < 20), "warning", "IRR outside plausible range"),
        Rule("ic_initial", num("ic_initial") >= 0, "error", "Invested capital cannot be negative"),
        Rule("ic_total", num("ic_total") >= 0, "error", "Invested capital cannot be negative"),
        Rule("realized", num("realized") >= 0, "warning", "Realized value should be non-negative"),
        Rule("unrealized", num("unrealized") >= 0, "warning", "Unrealized value should be non-negative"),
        Rule("total_value", num("total_value") >= 0, "warning", "Total value should be non-negative"),
        Rule("holding_period", (num("holding_period") > 0) & (num("holding_period") < 40), "warning", "Hold period outside 0-40 years"),
        Rule("fund_ownership", (num("fund_ownership") > 0) & (num("fund_ownership") <= 100), "warning", "Ownership percentage should be 0-100"),
        Rule("entry_date / exit_date", c("entry_date") <= c("exit_date"), "error", "Exit date precedes entry date", "row"),
        Rule("ic_total / realized", (num("ic_total") <= 0.5) | (num("realized") <= 200 * num("ic_total")), "warning", "Realized value is > 200x invested capital", "row"),
    ]


def issues(deals: DataFrame, rules: list[Rule] | None = None, key: str = "deal_id") -> DataFrame:
    """One row for each rule that a row breaks, in one pass; rules of absent columns are left out."""
    have = set(deals.columns)
    found = []
    for r in default_rules() if rules is None else rules:
        cols = r.field.split(" / ")
        if not have.issuperset(cols):
            continue
        value = F.concat_ws(" / ", *(F.coalesce(c(x).cast("string"), F.lit("")) for x in cols))
        item = F.struct(F.lit(r.severity).alias("severity"), F.lit(r.kind).alias("kind"), F.lit(r.field).alias("field_id"), value.alias("value"), F.lit(r.message).alias("message"))
        found.append(F.when(F.coalesce(~r.valid, F.lit(False)), item))
    return deals.select(key, F.explode(F.array_compact(F.array(*found))).alias("i")).select(key, "i.*")


def fill_issues(deals: DataFrame, file: str = "gp_name", required: tuple[str, ...] = ("company", "entry_date", "ic_total", "gross_moic")) -> DataFrame:
    """Required fields that are not mapped, or filled in less than half of a file's rows."""
    have = set(deals.columns)
    rates = deals.groupBy(file).agg(*(F.avg(c(f).isNotNull().cast("double")).alias(f) if f in have else F.lit(None).cast("double").alias(f) for f in required))
    long = rates.unpivot([file], list(required), "field_id", "fill")
    state = F.when(c("fill").isNull(), "not mapped").when(c("fill") < 0.5, "thinly filled")
    return long.withColumn("issue", state).where("issue IS NOT NULL").select(file, "field_id", "issue", F.round("fill", 6).alias("fill"))


def irr_unit_issues(deals: DataFrame, file: str = "gp_name") -> DataFrame:
    """Files whose IRRs look like percentage points."""
    v = c("gross_irr").cast("double")
    out = deals.groupBy(file).agg(F.count(v).alias("n"), F.avg(F.when(v.isNotNull(), (F.abs(v) > 3).cast("double"))).alias("large"))
    return out.where("n >= 3 AND large > 0.5").select(file, "n", F.round("large", 6).alias("large"))


def issue_labels(found: DataFrame, key: str = "deal_id") -> DataFrame:
    """A line for each issue."""
    return found.select(key, F.format_string("[%s] %s @ row %s: %s", F.upper("severity"), c("field_id"), c(key).cast("string"), c("message")).alias("label"))


def severity_counts(found: DataFrame) -> DataFrame:
    """Issues by severity and message."""
    return found.groupBy("severity", "field_id", "message").agg(F.count("*").alias("issues"))


def duplicates(rows: DataFrame, file: str = "file", row: str = "row_no") -> DataFrame:
    """P5: rows that repeat a company and fund of the same file without regard to case, with the first such row."""
    d = rows.withColumns({"k1": F.lower(F.trim("company")), "k2": F.lower(F.trim("fund"))}).where("k1 <> '' AND k2 <> ''")
    first = F.min(row).over(Window.partitionBy(file, "k1", "k2"))
    return d.withColumn("first_row", first).where(c(row) > c("first_row")).select(file, row, "company", "fund", "first_row")


#: Columns of the deal input that hold numbers and dates.
NUMERIC = ("total_ic", "realized", "current_value", "gross_tvpi", "gross_irr")
DATES = ("entry_date", "exit_date")


def _first_bad(rows: DataFrame, bad: str, file: str, shown: int) -> DataFrame:
    """(file, cells): the first bad cells of each file; ranks are cut before the shuffle, so no task holds a file's."""
    cells = rows.select(file, "row_no", F.posexplode(bad).alias("i", "x"))
    first = cells.withColumn("k", F.row_number().over(Window.partitionBy(file).orderBy("row_no", "i"))).where(c("k") <= shown)
    text = F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "row_no"))), lambda s: F.concat(s["x"], F.lit(" row "), s["row_no"].cast("string")))
    return first.groupBy(file).agg(F.array_join(text, "; ").alias("cells"))


def gate(rows: DataFrame, meta: DataFrame, file: str = "file", shown: int = 8) -> DataFrame:
    """For each file the counts behind errors and warnings, the first bad cells, and the decision.

    rows: text columns of the deal input by file and row_no; meta: file, gp_name, as_of, currency. decision: 1
    blocked, 2 needs consent, 0 publishable. Only the first ``shown`` bad cells of a file are listed, all count.
    """
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    bad_n = [F.when(~blank(x) & c(x).try_cast("double").isNull(), F.lit(x)) for x in NUMERIC]
    bad_d = [F.when(~blank(x) & S.to_date(c(x)).isNull(), F.lit(x)) for x in DATES]
    d = rows.withColumns({"n_bad": F.array_compact(F.array(*bad_n)), "d_bad": F.array_compact(F.array(*bad_d))})
    tvpi, irr, ic = (c(x).try_cast("double") for x in ("gross_tvpi", "gross_irr", "total_ic"))
    out = d.groupBy(file).agg(
        F.count("*").alias("rows"),
        F.count_if(blank(c("company"))).alias("blank_company"),
        F.sum(F.size("n_bad")).alias("bad_numbers"),
        F.sum(F.size("d_bad")).alias("bad_dates"),
        F.count_if(blank(c("fund"))).alias("blank_fund"),
        F.count_if(~blank(c("status")) & ~F.lower(F.trim("status")).isin("realized", "unrealized")).alias("other_status"),
        F.count_if(F.coalesce(tvpi < 0, F.lit(False))).alias("negative_tvpi"),
        F.count_if(F.coalesce(F.abs(irr) > 3, F.lit(False))).alias("large_irr"),
        F.count_if(blank(c("total_ic")) | F.coalesce(ic == 0, F.lit(False))).alias("no_ic"),
    )
    for bad, name in (("n_bad", "first_bad_numbers"), ("d_bad", "first_bad_dates")):
        out = out.join(_first_bad(d, bad, file, shown).withColumnRenamed("cells", name), file, "left").withColumn(name, F.coalesce(name, F.lit("")))
    out = meta.join(out, file, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    errors = blank(c("gp_name")) | c("as_of").isNull() | (c("rows") == 0) | (F.coalesce(c("blank_company") + c("bad_numbers") + c("bad_dates"), F.lit(0)) > 0)
    warnings = blank(c("currency")) | (F.coalesce(c("blank_fund") + c("other_status") + c("negative_tvpi") + c("large_irr") + c("no_ic"), F.lit(0)) > 0)
    return out.withColumn("decision", F.when(errors, 1).when(warnings, 2).otherwise(0))
