"""Table discovery in landed cell grids (B1 to B24, A1 to A3), for many files at once.

cells: (file_id, file_name, sheet, sheet_idx, sheet_state, row_no, col_no, value, vtype) with vtype s, n or d;
merges: (file_id, sheet, min_row, max_row, min_col, max_col).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.catalog import CELL_BLANKS, CURRENCIES, DEAL_KEYWORDS, SHEET_KEYWORDS, SKIP_SHEETS
from ..sources.shared import saved
from .segments import WIDTH, last_value, runs, with_group

c = F.col
SHEET = ["file_id", "sheet"]
BLOCK = [*SHEET, "block"]
MAX_ROWS, MAX_COLS, MAX_GAP, MAX_HEADERS = 2000, 300, 4, 5
# Patterns of labels, names and units.
ASOF = r"(?i)\b(as\s+of|as\s+at|data\s+as\s+of|report(ing)?\s+date|track\s+record\s+date|valuation\s+date|data\s+date)\b"
DESCRIPTORS = r"(?i)\b(consolidated|master|data\s*sheet|data|template|portfolio|workbook|report|spreadsheet|deal\s*level|gross|track\s*record|value\s*creation|analysis|equity|compan(y|ies)|all\s*funds|segmented|q[1-4]\b|fy\s*20\d\d|20\d\d)\b.*$"
TRAILING = r"(?is)\s+(equity|portfolio|workbook|track|record|data|report|management|capital|partners|fund|group|llp|llc|lp|gp|holdings|investments|advisors|associates|asset|private)\b.*$"
THOUSANDS = r"(?i)\bin\s+thousands\b|\(\s*(?:[$€£]|USD|EUR|GBP)?\s*(?:in\s+)?['’`]?000s?\s*\)|(?:[$€£]|\b(?:USD|EUR|GBP))\s*(?:in\s+)?['’`]000s?\b|\bin\s+['’`]?000s\b"
MILLIONS = r"(?i)\bin\s+millions\b|\(\s*(?:[$€£]|USD|EUR|GBP)?\s*(?:in\s+)?millions?\s*\)|(?:[$€£]|\b(?:USD|EUR|GBP))\s*mm\b"
CURRENCY = r"(?i)\b(" + "|".join(CURRENCIES) + r")\b"
TEXT_DATES = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyy/M/d")


def filled_cells(cells: DataFrame) -> DataFrame:
    """B1: cells that hold something, of whole sheets."""
    return cells.where(c("value").isNotNull() & ~F.trim("value").isin(*CELL_BLANKS))


def scanned(cells: DataFrame) -> DataFrame:
    """The first MAX_ROWS rows and MAX_COLS columns of each sheet, for callers that want no more."""
    return cells.where((c("row_no") <= MAX_ROWS) & (c("col_no") <= MAX_COLS))


def visible(cells: DataFrame) -> DataFrame:
    """B24."""
    return cells.where("sheet_state = 'visible'")


def row_summaries(cells: DataFrame) -> DataFrame:
    """One row for each row of a sheet that holds something: number, kinds and range of its filled cells.

    Discovery reads all cells once for these; all that follows up to the headers works on rows. Cells of a row that
    lie together are counted before the shuffle, in a hash table, as all aggregates are numbers.
    """
    year = r"\b(19|20)\d{2}\b"
    return filled_cells(cells).groupBy(*SHEET, "row_no").agg(
        F.count("*").alias("n"), F.min("col_no").alias("lo"), F.max("col_no").alias("hi"), F.count_if(c("vtype") == "s").alias("texts"), F.count_if(c("vtype") == "n").alias("nums"),
        F.max((c("vtype") == "d") | ((c("vtype") == "s") & c("value").rlike(year))).alias("dated"), F.min_by(F.ascii("vtype"), "col_no").alias("kind"),
    ).withColumn("kind", F.char("kind"))


def rows_of(cells: DataFrame) -> DataFrame:
    """Row summaries, given as such, or made from cells and written, as they are read several times."""
    return cells if "texts" in cells.columns else saved(row_summaries(cells), "rows")


def sheet_profiles(cells: DataFrame) -> DataFrame:
    """B2: used range and share of empty cells of whole sheets, from one pass over their cells."""
    g = filled_cells(cells).groupBy(*SHEET).agg(F.min("row_no").alias("min_row"), F.max("row_no").alias("max_row"), F.min("col_no").alias("min_col"), F.max("col_no").alias("max_col"), F.count("*").alias("filled"))
    area = (c("max_row") - c("min_row") + 1).cast("double") * (c("max_col") - c("min_col") + 1)
    return g.withColumn("empty", 1 - c("filled") / area)


def _least_density() -> Column:
    return F.greatest(F.lit(0.12), F.least(F.lit(0.20), 12 / F.greatest(c("width"), F.lit(60))))


def _with_density(cells: DataFrame) -> DataFrame:
    r = rows_of(cells)
    # A row a sheet, written, so that Spark knows how short the table is.
    sheets = saved(r.groupBy(*SHEET).agg((F.max("hi") - F.min("lo") + 1).alias("width")), "sheets")
    d = with_group(r, sheets, SHEET).withColumn("density", c("n") / c("width"))
    return d.withColumn("dense", c("density") >= _least_density())


def dense_rows(cells: DataFrame) -> DataFrame:
    """Rows filled enough for the width of their sheet."""
    return _with_density(cells).where("dense").select(*SHEET, "row_no", "density")


def _rows_by_block(cells: DataFrame, gap: int, width: int) -> DataFrame:
    """Row summaries with the number of their block, 0 above the first; written, as they are read several times.

    A block is a run of dense rows with no more than gap other rows between two; a row knows its block by counts over the
    rows above it. A sheet is scanned by ranges of ``width`` row numbers, and a row a range hands on what stands above.
    """
    part = [*SHEET, "__range"]
    here = F.when(c("dense"), c("row_no"))
    near = Window.partitionBy(*part).orderBy("row_no")
    above = F.max(here).over(near.rowsBetween(Window.unboundedPreceding, -1))
    d = _with_density(cells).withColumn("__range", F.floor(c("row_no") / width)).withColumn("__new", F.coalesce(c("dense") & (c("row_no") - above > gap + 1), F.lit(False)).cast("int"))
    d = saved(d.withColumn("__in", F.sum("__new").over(near.rowsBetween(Window.unboundedPreceding, 0))).drop("width", "density"), "rows")
    ends = d.groupBy(*part).agg(F.min(here).alias("__lo"), F.max(here).alias("__hi"), F.sum("__new").alias("__more"))
    before = Window.partitionBy(*SHEET).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    last = F.last("__hi", ignorenulls=True).over(before)
    starts = F.when(c("__lo").isNotNull(), F.coalesce(c("__lo") - last > gap + 1, F.lit(True)).cast("int")).otherwise(0)
    ends = ends.withColumn("__starts", starts)
    ends = saved(ends.withColumn("__base", F.coalesce(F.sum(c("__starts") + c("__more")).over(before), F.lit(0))).select(*part, "__lo", "__starts", "__base"), "ends")
    d = with_group(d, ends, part)
    block = c("__base") + F.when(c("row_no") >= c("__lo"), c("__starts") + c("__in")).otherwise(0)
    return d.withColumn("block", block).drop("__range", "__new", "__in", "__lo", "__starts", "__base")


_BOUNDS = ["first_row", "last_row", "first_col", "last_col"]


def _in_blocks(d: DataFrame, min_rows: int, min_cols: int) -> tuple[DataFrame, DataFrame]:
    """Rows of _rows_by_block() inside blocks, with the block's bounds, and the blocks with their bounds."""
    here = F.when(c("dense"), c("row_no"))
    b = d.where("block > 0").groupBy(*BLOCK).agg(F.min(here).alias("first_row"), F.max(here).alias("last_row")).where(c("last_row") - c("first_row") + 1 >= min_rows)
    b = saved(b, "blocks")
    # The columns are those of rows up to the last dense one.
    cols = with_group(d.where("block > 0"), b, BLOCK).where("row_no <= last_row").groupBy(*BLOCK).agg(F.min("lo").alias("first_col"), F.max("hi").alias("last_col"))
    b = saved(with_group(b, cols, BLOCK).where(c("last_col") - c("first_col") + 1 >= min_cols).select(*BLOCK, *_BOUNDS), "blocks")
    return with_group(d.where("block > 0"), b, BLOCK).where("row_no <= last_row"), b


def _with_headers(inside: DataFrame, b: DataFrame) -> DataFrame:
    """The blocks with their header rows and first data row.

    Headers are dense rows of text at the top of a block, up to the first dense row of another kind, or else its first row.
    """
    top = inside.where((c("row_no") < c("first_row") + MAX_HEADERS) & (c("row_no") < c("last_row")))  # MAX_HEADERS rows a block at most
    full = c("n") / (c("last_col") - c("first_col") + 1) >= 0.20
    good = full & (c("texts") / c("n") >= 0.45) & (c("nums") / c("n") < 0.40)
    stop = F.max((full & ~good).cast("int")).over(Window.partitionBy(*BLOCK).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0))
    found = top.withColumns({"good": good, "stop": stop}).where("good AND stop = 0").groupBy(*BLOCK).agg(F.sort_array(F.collect_list("row_no")).alias("header_rows"))
    d = with_group(b, found, BLOCK).withColumn("header_rows", F.coalesce("header_rows", F.array("first_row")))
    return saved(d.withColumn("data_row", F.array_max("header_rows") + 1), "tables")


def in_tables(cells: DataFrame, gap: int = MAX_GAP, min_rows: int = 3, min_cols: int = 2, width: int = WIDTH) -> DataFrame:
    """The row summaries inside blocks, with the block's bounds, header rows and first data row.

    No row is compared with a block, however many blocks a sheet has, and no sheet is scanned in one task.
    """
    inside, b = _in_blocks(_rows_by_block(cells, gap, width), min_rows, min_cols)
    t = _with_headers(inside, b)
    return with_group(inside.drop(*_BOUNDS), t, BLOCK).where("data_row IS NOT NULL")


def blocks(cells: DataFrame, gap: int = MAX_GAP, min_rows: int = 3, min_cols: int = 2) -> DataFrame:
    """B4 of the scanned part of a sheet: runs of dense rows and their columns. blocks_by_ranges() goes over whole sheets."""
    return _in_blocks(_rows_by_block(scanned(cells), gap, WIDTH), min_rows, min_cols)[1]


def blocks_by_ranges(cells: DataFrame, gap: int = MAX_GAP, min_rows: int = 3, min_cols: int = 2, width: int = WIDTH) -> DataFrame:
    """B4 over whole sheets of any length: the same blocks without the scan's limits, and without a sheet in one task.

    Rows are numbered by ranges of ``width`` row numbers, and bounds are grouped, not windowed.
    """
    r = filled_cells(cells).groupBy(*SHEET, "row_no").agg(F.count("*").alias("n"), F.min("col_no").alias("lo"), F.max("col_no").alias("hi"))
    sheets = r.groupBy(*SHEET).agg((F.max("hi") - F.min("lo") + 1).alias("width"))
    r = with_group(r, sheets, SHEET)
    dense = runs(r.where(c("n") / c("width") >= _least_density()), SHEET, "row_no", gap, "run", width)
    bounds = dense.groupBy(*SHEET, "run").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))
    marked = r.join(dense.select(*SHEET, "row_no", "run"), [*SHEET, "row_no"], "left")
    inside = last_value(marked, SHEET, "row_no", c("run"), "block", width).drop("run").where("block IS NOT NULL")
    inside = inside.join(bounds.withColumnRenamed("run", "block"), BLOCK).where("row_no <= last_row")
    out = inside.groupBy(*BLOCK, "first_row", "last_row").agg(F.min("lo").alias("first_col"), F.max("hi").alias("last_col"))
    return out.where((c("last_row") - c("first_row") + 1 >= min_rows) & (c("last_col") - c("first_col") + 1 >= min_cols))


def tables(cells: DataFrame, width: int = WIDTH) -> DataFrame:
    """All blocks of whole sheets with their header rows and first data row, from cells or row summaries."""
    return _with_headers(*_in_blocks(_rows_by_block(cells, MAX_GAP, width), 3, 2))


def header_rows(cells: DataFrame, b: DataFrame) -> DataFrame:
    """blocks() with their header rows and first data row."""
    return b.join(tables(scanned(cells)).select(*BLOCK, "header_rows", "data_row"), BLOCK)


def headers(cells: DataFrame, merges: DataFrame, h: DataFrame) -> DataFrame:
    """(file, sheet, block, col_no, header): labels of all header rows joined, merged ones spread, made unique."""
    # Header rows are few and written, so that Spark knows it and need not shuffle cells for them.
    at = saved(h.select(*BLOCK, "first_col", "last_col", F.explode("header_rows").alias("row_no")))
    top = filled_cells(cells).join(at, [*SHEET, "row_no"]).select(*BLOCK, "row_no", "col_no", F.trim("value").alias("v"))
    m = merges.join(filled_cells(cells).select(*SHEET, c("row_no").alias("min_row"), c("col_no").alias("min_col"), F.trim("value").alias("v")), [*SHEET, "min_row", "min_col"])
    # A merge meets the headers row by row, not all blocks of its sheet.
    m = m.withColumn("row_no", F.explode(F.sequence("min_row", "max_row"))).join(at, [*SHEET, "row_no"])
    spread = m.withColumn("col_no", F.explode(F.sequence("min_col", "max_col"))).where(c("col_no").between(c("first_col"), c("last_col")))
    parts = spread.select(*BLOCK, "row_no", "col_no", "v", F.lit(0).alias("own")).union(top.select(*BLOCK, "row_no", "col_no", "v", F.lit(1).alias("own")))
    parts = parts.groupBy(*BLOCK, "row_no", "col_no").agg(F.min_by("v", "own").alias("v"))
    names = parts.groupBy(*BLOCK, "col_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "v"))), lambda x: x["v"]).alias("vs"))
    names = names.withColumn("header", F.array_join(F.filter("vs", lambda x, i: (i == 0) | (x != F.get("vs", i - 1))), " | "))
    cols = h.select(*BLOCK, "first_col", F.explode(F.sequence("first_col", "last_col")).alias("col_no"))
    d = cols.join(names.drop("vs"), [*BLOCK, "col_no"], "left")
    d = d.withColumn("header", F.when(F.coalesce(F.trim("header"), F.lit("")) == "", F.concat(F.lit("_col"), (c("col_no") - c("first_col") + 1).cast("string"))).otherwise(F.trim("header")))
    k = F.row_number().over(Window.partitionBy(*BLOCK, "header").orderBy("col_no")) - 1
    return d.withColumn("k", k).select(*BLOCK, "col_no", F.when(c("k") > 0, F.concat("header", F.lit("."), c("k").cast("string"))).otherwise(c("header")).alias("header"))


def keyword_hits(text: Column) -> Column:
    return F.aggregate(F.array(*map(F.lit, DEAL_KEYWORDS)), F.lit(0), lambda a, k: a + text.contains(k).cast("int"))


def candidates(cells: DataFrame, merges: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Blocks with orientation, density, what they hold, a score of 0 to 100, and whether deals are likely.

    rows: row_summaries(cells), where they are kept; cells are then read for the headers only.
    """
    d = in_tables(cells if rows is None else rows).where("data_row <= last_row")
    data, leads = c("row_no") >= c("data_row"), c("lo") == c("first_col")  # the row has a cell in the block's first column
    d = d.where(data).groupBy(*BLOCK, *_BOUNDS, "data_row", "header_rows").agg(
        F.sum("n").alias("n"), F.max(c("dated").cast("int")).alias("has_date"), F.max((c("nums") > 0).cast("int")).alias("has_number"),
        F.avg(F.when(leads, (c("kind") == "s").cast("double"))).alias("first_text"),
        F.max(F.when(c("row_no") == c("data_row"), F.try_divide(c("nums") - (leads & (c("kind") == "n")).cast("int"), c("n") - leads.cast("int")))).alias("row_num"),
    )
    d = saved(d)
    labels = headers(cells, merges, d).where(~c("header").rlike(r"^_col\d+$")).groupBy(*BLOCK).agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "header"))), lambda x: x["header"]).alias("sample_headers"))
    d = d.join(labels, BLOCK, "left").withColumn("sample_headers", F.coalesce("sample_headers", F.array().cast("array<string>")))
    d = d.withColumns({"rows": c("last_row") - c("data_row") + 1, "cols": c("last_col") - c("first_col") + 1, "hits": keyword_hits(F.lower(F.array_join("sample_headers", " ")))})
    turned = F.when(c("first_text").isNull(), "unknown").when((c("first_text") > 0.75) & (c("row_num") > 0.5), "col_per_record").otherwise("row_per_record")
    d = d.withColumns({"orientation": turned, "density": c("n") / (c("rows").cast("double") * c("cols"))})
    score = F.least(F.lit(25.0), 8 * F.log1p("rows")) + F.least(F.lit(20.0), 2.0 * c("cols")) + 15 * F.least("density", F.lit(1.0)) + 10 * c("has_date") + 10 * c("has_number") + F.least(F.lit(20.0), 2.0 * c("hits")) - F.when(c("orientation") == "col_per_record", 10).otherwise(0)
    return d.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), "likely": (c("hits") >= 3) & (c("rows") >= 3)})


def primary_tables(found: DataFrame, sheets: DataFrame) -> DataFrame:
    """The candidate of each file with the highest score; ties go to the earlier sheet and block."""
    d = found.join(sheets.select(*SHEET, "sheet_idx").distinct(), SHEET)
    w = Window.partitionBy("file_id").orderBy(F.desc("score"), "sheet_idx", "block")
    return d.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def layouts(found: DataFrame, sheets: DataFrame, ratio: float = 0.75, overlap: float = 0.5) -> DataFrame:
    """per_fund where other sheets hold a likely table of the primary one's width and of its header words, else consolidated.

    Words are those of the first 15 headers; of each sheet its best likely table is compared.
    """
    toks = F.array_distinct(F.filter(F.split(F.lower(F.array_join(F.slice("sample_headers", 1, 15), " ")), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))
    d = found.join(sheets.select(*SHEET, "sheet_idx").distinct(), SHEET)
    # The tables of one file, best first as in primary_tables().
    table = F.struct((-c("score")).alias("rank"), "sheet_idx", "block", "sheet", "cols", toks.alias("toks"), "likely")
    d = d.groupBy("file_id").agg(F.array_sort(F.collect_list(table)).alias("tables")).withColumns({"p": F.get("tables", F.lit(0)), "good": F.filter("tables", lambda t: t["likely"])})
    names = F.transform("good", lambda t: t["sheet"])
    best = F.filter("good", lambda t, i: F.array_position(names, t["sheet"]) == i + 1)  # of each sheet
    p = c("p")
    share = lambda t: F.size(F.array_intersect(t["toks"], p["toks"])) / F.size(F.array_union(t["toks"], p["toks"]))
    same = lambda t: (t["sheet"] != p["sheet"]) & (F.least(t["cols"], p["cols"]) / F.greatest(t["cols"], p["cols"]) >= ratio) & (F.size(t["toks"]) > 0) & (share(t) >= overlap)
    d = d.withColumn("siblings", F.filter(best, same))
    every = F.array_sort(F.transform(F.concat(F.array("p"), "siblings"), lambda t: F.struct(t["sheet_idx"].alias("sheet_idx"), t["sheet"].alias("sheet"))))
    return d.select("file_id", F.when(F.size("siblings") == 0, "consolidated").otherwise("per_fund").alias("layout"), F.transform(every, lambda x: x["sheet"]).alias("sheets"))


def _ends(h: DataFrame) -> DataFrame:
    """Tables with the first row of the next one on their sheet."""
    end = F.lead("first_row").over(Window.partitionBy(*SHEET).orderBy("first_row"))
    return h.select(*BLOCK, "first_row", "data_row").withColumn("end", end).drop("first_row")


def _of_tables(cells: DataFrame, ends: DataFrame, width: int = 64) -> DataFrame:
    """Cells with the block of the table they belong to, from its data_row on to its end; those of no table go.

    The last table of a sheet has no end. Of the others, a cell meets those of its range of ``width`` row numbers only.
    """
    last = ends.where("end IS NULL").select(*SHEET, c("block").alias("__last"), c("data_row").alias("__from"))
    ranges = F.sequence(F.floor(c("data_row") / width), F.floor((c("end") - 1) / width))
    other = ends.where("data_row < end").select(*(c(k).alias(f"__of_{k}") for k in SHEET), c("block").alias("__block"), "data_row", "end", F.explode(ranges).alias("__of_range"))
    inside = (c("__range") == c("__of_range")) & (c("row_no") >= c("data_row")) & (c("row_no") < c("end"))
    for k in SHEET:
        inside &= c(k) == c(f"__of_{k}")
    d = cells.join(last, SHEET, "left").withColumn("__range", F.floor(c("row_no") / width)).join(saved(other, "ends"), inside, "left")
    d = d.withColumn("block", F.coalesce("__block", F.when(c("row_no") >= c("__from"), c("__last")))).where("block IS NOT NULL")
    return d.select(*cells.columns, "block")


def table_rows(cells: DataFrame, merges: DataFrame, h: DataFrame) -> DataFrame:
    """A1: rows of tables with known headers as maps from header to value; blank rows do not arise.

    Rows are read from data_row on to the end of the sheet, or to the row before
    the next table that h has on it.
    """
    # Tables and their headers are written, so that Spark knows how short they are; cells are shuffled once, by rows, without headers.
    h = saved(h)
    names = headers(cells, merges, h).groupBy(*BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("col_no", "header"))).alias("names"))
    ends = saved(_ends(h).join(names, BLOCK))
    d = _of_tables(filled_cells(cells).select(*SHEET, "row_no", "col_no", "value"), ends)
    d = d.groupBy(*BLOCK, "row_no").agg(F.collect_list(F.struct("col_no", "value")).alias("row")).join(ends.select(*BLOCK, "names"), BLOCK)
    named = F.filter("row", lambda x: F.map_contains_key("names", x["col_no"]))
    vals = F.transform(named, lambda x: F.struct(F.element_at("names", x["col_no"]).alias("header"), x["value"].alias("value")))
    return d.where(F.size(named) > 0).select(*BLOCK, "row_no", F.map_from_entries(vals).alias("vals"))


def _input_parts(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of deal-input grids below their header row, and their headers: those without a gap from column 2 on."""
    clean = F.trim(F.regexp_replace("value", r"\s+", " "))
    # Header rows, headers and ends are a few rows a file and are written, so that Spark knows it and need not shuffle cells by file.
    top = saved(cells.where((c("col_no") == 2) & (c("row_no") <= 25) & (F.lower(clean) == "company")).groupBy("file_id").agg(F.min("row_no").alias("header_row")))
    full = cells.where((F.trim("value") != "") & (c("col_no") >= 2)).join(top, "file_id").where("row_no >= header_row")
    names = full.where("row_no = header_row").select("file_id", "col_no", clean.alias("header"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("col_no"))
    return full, saved(names.withColumn("k", place).where("k = col_no - 1").drop("k"))


def input_headers(cells: DataFrame) -> DataFrame:
    """A2: (file_id, header) of deal-input grids."""
    return _input_parts(cells)[1].select("file_id", "header")


def input_grid(cells: DataFrame) -> DataFrame:
    """A2: rows of deal-input grids as (file_id, row_no, header, value): below the row that says Company in column 2, up to the first row that is blank under all headers."""
    full, names = _input_parts(cells)
    under = full.join(names, ["file_id", "col_no"])
    # The first blank row follows the first row after which one is missing; only gaps are ranked, not all rows.
    rows = under.select("file_id", "row_no", "header_row").distinct()
    after = rows.select("file_id", (c("row_no") + 1).alias("row_no"))
    gaps = after.join(rows.select("file_id", "row_no"), ["file_id", "row_no"], "left_anti").groupBy("file_id").agg(F.min("row_no").alias("end"))
    return under.join(saved(gaps), "file_id").where("row_no > header_row AND row_no < end").select("file_id", "row_no", "header", F.trim("value").alias("value"))


def input_meta(cells: DataFrame) -> DataFrame:
    """A2: (file_id, gp_name, as_of, currency) of all deal-input grids: labels in column 2 of the first 15 rows, values beside them.

    Of a label that occurs twice the lower one counts, with a value for name and currency; a date that cannot be read is null.
    """
    top = cells.where("row_no <= 15")
    label = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    labels = top.where("col_no = 2").select("file_id", "row_no", label.alias("label")).where(c("label").isin("gp name", "track record date", "currency"))
    beside = labels.join(top.where("col_no = 3").select("file_id", "row_no", F.trim("value").alias("v")), ["file_id", "row_no"], "left")
    last = lambda name, value: F.max_by(value, F.when((c("label") == name) & (value.isNotNull() | F.lit(name == "track record date")), c("row_no")))
    meta = beside.groupBy("file_id").agg(last("gp name", c("v")).alias("gp_name"), last("track record date", S.to_date(c("v"))).alias("as_of"), last("currency", c("v")).alias("currency"))
    return cells.select("file_id").distinct().join(meta, "file_id", "left")


def header_differences(found: DataFrame, expected: list[str]) -> DataFrame:
    """A3: expected headers that a file lacks and headers that are not expected, without regard to case. found: (file_id, header)."""
    g = found.groupBy("file_id").agg(F.collect_set(F.lower("header")).alias("have"))
    want = F.array(*(F.lit(x.lower()) for x in expected))
    return g.select("file_id", F.sort_array(F.array_except(want, "have")).alias("missing"), F.sort_array(F.array_except("have", want)).alias("unknown"))


def text_date(raw: Column) -> Column:
    """A date in text by ten formats, or the last day of a quarter."""
    s = F.substring(F.trim(raw), 1, 20)
    q, y = F.regexp_extract(s, r"(?i)^Q([1-4])\s+(\d{4})", 1), F.regexp_extract(s, r"(?i)^Q([1-4])\s+(\d{4})", 2)
    quarter = F.when(q != "", F.last_day(F.make_date(y.try_cast("int"), q.try_cast("int") * 3, F.lit(1))))
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)).cast("date") for f in TEXT_DATES), quarter)


def gp_from_file_name(name: Column) -> Column:
    """What stands before a separator or a descriptor; empty where nothing fits."""
    s = F.regexp_replace(F.regexp_replace(name, r"^.*[\\/]", ""), r"(?i)\.(xlsx|xlsm|xls)$", "")
    s = F.trim(F.regexp_replace(F.trim(s), r"^[\[\]]+", ""))
    s = F.trim(F.substring_index(s, " - ", 1))
    s = F.regexp_replace(F.trim(F.regexp_replace(s, DESCRIPTORS, "")), r"^[ _-]+|[ _-]+$", "")
    return F.when(F.length(s).between(1, 60), s).otherwise("")


def date_from_file_name(name: Column) -> Column:
    """Year-month-day, month-day-year (swapped where the month is above 12), or the end of a quarter."""
    s = F.regexp_replace(name, r"^.*[\\/]", "")

    def made(pattern, y, m, d):
        part = lambda i: F.regexp_extract(s, pattern, i).try_cast("int")
        year, month, day = part(y), part(m), part(d)
        swap = (month > 12) & (day <= 12)
        text = F.format_string("%04d-%02d-%02d", year, F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day))
        return F.when(year.between(1990, 2100), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))

    quarter = lambda p, q, y: F.when(F.regexp_extract(s, p, 0) != "", F.last_day(F.make_date(F.regexp_extract(s, p, y).try_cast("int"), F.regexp_extract(s, p, q).try_cast("int") * 3, F.lit(1))))
    return F.coalesce(made(r"(\d{4})[._-](\d{1,2})[._-](\d{1,2})", 1, 2, 3), made(r"(\d{1,2})[._-](\d{1,2})[._-](\d{4})", 3, 1, 2), quarter(r"(?i)Q([1-4])\s*[' ]?(\d{4})", 1, 2), quarter(r"(?i)(\d{4})\s*[' ]?Q([1-4])", 2, 1))


def track_record_dates(cells: DataFrame) -> DataFrame:
    """Of each file the date beside, below or inside an as-of label at its top, else the one in its name, else the first date of its banner."""
    top = visible(cells).where("row_no <= 12 AND col_no <= 25")
    at = top.where((c("vtype") == "s") & c("value").rlike(ASOF)).select("file_id", "sheet", "sheet_idx", "row_no", "col_no", text_date(F.regexp_replace(F.regexp_replace("value", r"(?is)^.*" + ASOF[4:], ""), r"^[ :,-]+|[ :,-]+$", "")).alias("inline"))
    near = top.select("file_id", "sheet", c("row_no").alias("r"), c("col_no").alias("k"), text_date(c("value")).alias("d"))
    place = F.when((c("r") == c("row_no")) & (c("k") == c("col_no") + 1), 1).when((c("r") == c("row_no")) & (c("k") == c("col_no") + 2), 2).when((c("r") == c("row_no") + 1) & (c("k") == c("col_no")), 3)
    beside = at.join(near, ["file_id", "sheet"]).withColumn("p", place).where("p IS NOT NULL AND year(d) >= 1990").select("file_id", "sheet_idx", "row_no", "col_no", "p", "d")
    every = at.where("inline IS NOT NULL").select("file_id", "sheet_idx", "row_no", "col_no", F.lit(0).alias("p"), c("inline").alias("d")).union(beside)
    best = every.groupBy("file_id").agg(F.min_by("d", F.struct("sheet_idx", "row_no", "col_no", "p")).alias("label_date"))
    files = cells.select("file_id", "file_name").distinct().join(best, "file_id", "left").join(first_dates(cells), "file_id", "left")
    return files.select("file_id", F.coalesce("label_date", date_from_file_name(c("file_name")), "first_date").alias("as_of"))


def first_dates(cells: DataFrame) -> DataFrame:
    """(file_id, first_date): the first date in the banners of a file's visible sheets, as a date from 1990 on or as text."""
    top = visible(cells).where("row_no <= 10 AND col_no <= 20")
    typed = F.when(c("vtype") == "d", F.substring(F.trim("value"), 1, 10).try_cast("date"))
    day = F.coalesce(F.when(F.year(typed) >= 1990, typed), F.when(c("vtype") == "s", text_date(c("value"))))
    return top.withColumn("day", day).where("day IS NOT NULL").groupBy("file_id").agg(F.min_by("day", F.struct("sheet_idx", "row_no", "col_no")).alias("first_date"))


def unit_banner(cells: DataFrame) -> DataFrame:
    """K or m where the banners of a file's visible sheets agree."""
    top = visible(cells).where("row_no <= 12 AND vtype = 's'")
    units = F.array_compact(F.array(F.when(c("value").rlike(THOUSANDS), "k"), F.when(c("value").rlike(MILLIONS), "m")))
    g = top.select("file_id", F.explode(units).alias("u")).groupBy("file_id").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    return cells.select("file_id").distinct().join(g, "file_id", "left").select("file_id", F.when(c("lo") == c("hi"), c("lo")).alias("banner"))


def metadata(cells: DataFrame) -> DataFrame:
    """Up to five names of the manager, the file's name first, and the first currency in the banner."""
    top = visible(cells).where("row_no <= 10 AND col_no <= 20").withColumn("v", F.trim("value"))
    place = F.struct("sheet_idx", "row_no", "col_no")
    code = F.regexp_extract("v", CURRENCY, 1)
    money = top.where(code != "").groupBy("file_id").agg(F.upper(F.min_by(code, place)).alias("currency"))
    name = F.trim(F.regexp_replace("v", TRAILING, ""))
    named = top.where((c("vtype") == "s") & F.length("v").between(4, 80) & (code == "")).withColumn("name", name).where(F.length("name").between(4, 60))
    # Each name at its first place; six of them, as one may be the file's own.
    named = named.groupBy("file_id", "name").agg(F.min(place).alias("place"))
    named = named.withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("place"))).where("k <= 6")
    names = named.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("names"))
    files = cells.groupBy("file_id").agg(F.first("file_name").alias("file_name"))
    d = files.join(names, "file_id", "left").join(money, "file_id", "left").withColumn("own", gp_from_file_name(c("file_name")))
    every = F.filter(F.concat(F.array("own"), F.coalesce("names", F.array().cast("array<string>"))), lambda x: x != "")
    return d.select("file_id", F.slice(F.array_distinct(every), 1, 5).alias("gp_names"), "currency")


def banner_meta(cells: DataFrame, h: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Of the rows above a table, the first date after 1990 and the first name, cut before a descriptor; and its currency.

    The currency is the first value of the first column with values whose header speaks of currency, USD without one;
    names: headers() of the tables.
    """
    above = cells.join(h.select(*BLOCK, F.array_min("header_rows").alias("top")), SHEET).where("row_no < top AND row_no <= 10").withColumn("v", F.trim("value"))
    place = F.struct("row_no", "col_no")
    d = F.when(c("vtype") == "d", c("v").try_cast("date"))
    name = F.when(d.isNull() & (F.length("v") > 3), F.trim(F.regexp_replace("v", r"(?is)\s+(equity|portfolio|workbook|track|record|data).*$", "")))
    out = above.groupBy(*BLOCK).agg(F.min_by(d, F.when(F.year(d) > 1990, place)).alias("report_date"), F.min_by(name, F.when(name.isNotNull(), place)).alias("gp_name"))
    if names is None:
        return out
    money = names.where(F.lower("header").contains("currency") & ~c("header").startswith("_col")).select(*BLOCK, "col_no")
    below = _of_tables(filled_cells(cells), saved(_ends(h))).join(money, [*BLOCK, "col_no"])
    first = below.groupBy(*BLOCK).agg(F.min_by(F.trim("value"), F.struct("col_no", "row_no")).alias("currency"))
    every = h.select(*BLOCK).join(out, BLOCK, "left").join(first, BLOCK, "left")
    return every.withColumn("currency", F.coalesce("currency", F.lit("USD")))


def sheet_scores(sheets: DataFrame) -> DataFrame:
    """How likely a sheet holds deals by its name, which one is the main sheet, and which ones hold deals."""
    n = F.lower("sheet")
    hits = lambda words, w: F.aggregate(F.array(*map(F.lit, words)), F.lit(0), lambda a, k: a + F.when(n.contains(k), w).otherwise(0))
    score = F.when(n.rlike(r"^sheet\d*$"), 0).otherwise(hits(SHEET_KEYWORDS, 2) - hits(SKIP_SHEETS, 1) + 1)
    d = sheets.select("file_id", "sheet", "sheet_idx").distinct().withColumn("score", score)
    f = Window.partitionBy("file_id")
    d = d.withColumns({"best": F.max("score").over(f), "n": F.count("*").over(f), "k": F.row_number().over(f.orderBy(F.desc("score"), "sheet_idx")), "last": F.max("sheet_idx").over(f)})
    main = F.when((c("best") <= 0) & (c("n") > 1), c("sheet_idx") == c("last")).otherwise(c("k") == 1)
    return d.select("file_id", "sheet", "sheet_idx", "score", main.alias("is_main"), F.when(c("best") > 0, c("score") > 0).otherwise(c("k") == 1).alias("is_deal_sheet"))


def widest_row(cells: DataFrame, rows: int = 30) -> DataFrame:
    """The row with the most filled cells at the top of a sheet, the earliest of equals."""
    g = cells.where((c("row_no") <= rows) & ~F.trim("value").isin("", "-")).groupBy(*SHEET, "row_no").agg(F.count("*").alias("n"))
    return g.groupBy(*SHEET).agg(F.max_by("row_no", F.struct("n", (-c("row_no")).alias("r"))).alias("header_row"))
