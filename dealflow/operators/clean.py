"""From raw rows to deal rows: section banners, fallbacks, keep-first, and the removal of other rows.

Rows are text columns by file, tab and row_no; company, fund and entry_date may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_blank, is_number
from .segments import WIDTH, last_value, with_group

c = F.col
# Patterns of text that is no deal.
ANNOTATION = (
    r"(?i)^\s*[-–—•·▪◦*†‡]\s+\S|\b(footnote|refer\s+to|data\s*room|please\s+(refer|see|note)|disclaimer|source\s*:|represents?\s+schedules?|important\s+note"
    r"|data\s+template|for\s+illustrative|past\s+performance|not\s+indicative|the\s+calculation\s+reflects|column\s+reference)\b"
)
TOTAL = r"(?i)^\s*(grand\s+total|sub\s*total|total|portfolio\s+total|aggregate|sum)\s*$"
NOTE = r"(?i)^\s*(notes?|footnotes?)\s*:?\s*$"
AGGREGATE = r"(?i)^\s*all\b|\(\s*\d{4}\s*[-–—]\s*(\d{4}|present|current|today)\s*\)"
VINTAGE_TAIL = r"(?i)\s*\(\s*vintage[^)]*\)\s*$"


def _words(s: Column) -> Column:
    return F.when(F.trim(s) == "", 0).otherwise(F.size(F.split(F.trim(s), r"\s+")))


def is_annotation(raw: Column) -> Column:
    """A footnote, disclaimer or total."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    return (s != "") & (s.rlike(ANNOTATION) | s.rlike(TOTAL))


def is_note_header(raw: Column) -> Column:
    """A heading of notes, prose, or the heading of an aggregate view."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    return s.rlike(NOTE) | s.startswith("(") | (F.length(s) > 80) | (_words(s) > 10) | s.rlike(AGGREGATE)


def inherit_sections(rows: DataFrame, values: list[str], width: int = WIDTH) -> DataFrame:
    """A row with a company and nothing else names the fund of the rows below it, within its tab.

    Files whose fund column is more than half filled, and files where no banner stands above a row, stay as they
    are. Banner rows go. values: the columns besides company that must be blank in a banner. A tab is scanned by ranges
    of ``width`` row numbers, so no task holds a file.
    """
    others = None
    for v in values:
        others = is_blank(c(v)) if others is None else others & is_blank(c(v))
    banner = ~is_blank(c("company")) & others & ~is_annotation(c("company")) & ~is_note_header(c("company"))
    d = rows.withColumn("__banner", F.coalesce(banner, F.lit(False)))
    name = F.regexp_replace(F.trim("company"), VINTAGE_TAIL, "")
    d = last_value(d, ["file", "tab"], "row_no", F.when(c("__banner"), name), "__section", width)
    used = F.max((c("__section").isNotNull() & ~c("__banner")).cast("int")) == 1
    files = d.groupBy("file").agg(((F.avg((~is_blank(c("fund"))).cast("double")) <= 0.5) & used).alias("__on"))
    d = with_group(d, files, ["file"])
    d = d.withColumn("fund", F.when(c("__on"), F.coalesce("__section", "tab")).otherwise(c("fund")))
    return d.where("NOT (__on AND __banner)").select(*rows.columns)


def fund_from_tab(rows: DataFrame) -> DataFrame:
    """E5: the tab names the fund where more than half of a file's funds are missing."""
    files = rows.groupBy("file").agg((F.avg(c("fund").isNull().cast("double")) > 0.5).alias("__missing"))
    return with_group(rows, files, ["file"]).withColumn("fund", F.when(c("__missing"), c("tab")).otherwise(c("fund"))).drop("__missing")


def keep_first(rows: DataFrame) -> DataFrame:
    """Of rows of one file that agree in company, fund and entry date, the first; of one row number, the last tab's."""
    w = Window.partitionBy("file", "company", "fund", "entry_date").orderBy("row_no", F.desc("tab"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def tagged(rows: DataFrame, financial: list[str]) -> DataFrame:
    """Rows with the rule that drops them, null for deals.

    annotation; fund_name (the company is a fund of the file, without a date); sentence (long text without date
    and figures); empty (no company, date or figure).
    """
    figures = F.lit(False)
    for f in financial:
        figures = figures | is_number(c(f))
    dated, named = ~is_blank(c("entry_date")), ~is_blank(c("company"))
    text = F.trim(F.coalesce("company", F.lit("")))
    funds = rows.where(F.trim("fund") != "").select(c("file").alias("__f"), F.trim("fund").alias("__fund")).distinct()
    d = rows.join(funds, (c("file") == c("__f")) & (F.trim("company") == c("__fund")), "left")
    long = (text != "") & ((F.length(text) > 60) | text.endswith(":") | (_words(text) >= 10))
    rule = (
        F.when(is_annotation(c("fund")) | is_annotation(c("company")), "annotation")
        .when(c("__fund").isNotNull() & ~dated, "fund_name")
        .when(long & ~dated & ~figures, "sentence")
        .when(~named & ~dated & ~figures, "empty")
    )
    return d.withColumn("rule", rule).drop("__f", "__fund")


def deal_rows(rows: DataFrame, financial: list[str]) -> DataFrame:
    """The rows that no rule drops."""
    return tagged(rows, financial).where("rule IS NULL").drop("rule")


def drop_report(rows: DataFrame, financial: list[str]) -> DataFrame:
    """Dropped rows by file and rule."""
    return tagged(rows, financial).where("rule IS NOT NULL").groupBy("file", "rule").agg(F.count("*").alias("dropped"))


def excluded(deals: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Deals with a flag; without a predicate all are included."""
    return deals.withColumn("excluded", F.coalesce(predicate, F.lit(False)) if predicate is not None else F.lit(False))
