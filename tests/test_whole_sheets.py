"""Discovery reads whole sheets: below row 2,000, right of column 300, and no sheet in one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dealflow.operators import discover


def _cells(spark, rows):
    """Cells (sheet, row_no, col_no, value); numbers get their kind."""
    rows = [("f", s, r, k, str(v), "n" if isinstance(v, int) else "s") for s, r, k, v in rows]
    return spark.createDataFrame(rows, "file_id string, sheet string, row_no int, col_no int, value string, vtype string")


def test_profile_of_a_whole_sheet(spark):
    cells = _cells(spark, [("s", 3, 2, "Company"), ("s", 2500, 2, "Last"), ("s", 10, 400, "right"), ("s", 2501, 401, "-"), ("far", 3000, 1, "x"), ("wide", 2_000_000_000, 16_000, "x"), ("wide", 1, 1, "x")])
    got = {r.sheet: (r.min_row, r.max_row, r.min_col, r.max_col, r.filled, r.empty) for r in discover.sheet_profiles(cells).collect()}
    assert got["s"] == (3, 2500, 2, 400, 3, 1 - 3 / (2498 * 399)) and got["far"] == (3000, 3000, 1, 1, 1, 0.0)
    assert got["wide"][:5] == (1, 2_000_000_000, 1, 16_000, 2) and 0.999 < got["wide"][5] < 1


def test_twin_of_the_profile_has_no_limit():
    from dealflow.plans import registry

    assert "1996" not in registry.ORACLE_SQL["B1_B2_sheet_profiles"]


def _sheets(seed):
    """Sheets of dense and sparse rows with gaps, cells of all kinds, and header-like rows at the top of runs."""
    r, rows = random.Random(seed), []
    for s in ("s", "t", "u"):
        at = r.choice([1, 90])
        for _ in range(150):
            at += r.choice([1, 1, 1, 1, 1, 2, 5, 6, 9])
            wide = r.choice([1, 3, 8, 11, 12])
            rows += [(s, at, k, f"text {r.random()}" if r.random() < r.choice([0.2, 0.9]) else r.randrange(1900, 2100)) for k in range(2, 2 + wide)]
    return rows


def _plain(rows, gap=4, min_rows=3, min_cols=2):
    """B4 and B5 row by row: (sheet, first_row, last_row, first_col, last_col, header_rows, data_row)."""
    out = []
    for s in sorted({x[0] for x in rows}):
        line = {}
        for _, at, k, v in (x for x in rows if x[0] == s):
            line.setdefault(at, {})[k] = v
        width = max(max(x) for x in line.values()) - min(min(x) for x in line.values()) + 1
        least = max(0.12, min(0.20, 12 / max(width, 60)))
        runs = []
        for at in sorted(x for x in line if len(line[x]) / width >= least):
            if runs and at - runs[-1][-1] <= gap + 1:
                runs[-1].append(at)
            else:
                runs.append([at])
        for run in runs:
            first, last = run[0], run[-1]
            inside = [x for x in sorted(line) if first <= x <= last]
            lo, hi = min(min(line[x]) for x in inside), max(max(line[x]) for x in inside)
            if last - first + 1 < min_rows or hi - lo + 1 < min_cols:
                continue
            heads = []
            for at in (x for x in inside if x < first + 5 and x < last):
                texts = sum(isinstance(v, str) for v in line[at].values())
                n = len(line[at])
                if n / (hi - lo + 1) < 0.20:
                    continue
                if texts / n < 0.45 or (n - texts) / n >= 0.40:
                    break
                heads.append(at)
            heads = heads or [first]
            out.append((s, first, last, lo, hi, heads, heads[-1] + 1))
    return out


@pytest.mark.parametrize("width", [1, 7, 59, 10**9])
def test_tables_by_ranges(spark, width):
    """Scanned by ranges of any width, tables are those found row by row."""
    rows = _sheets(4)
    t = discover.tables(_cells(spark, rows).repartition(3), width=width)
    got = sorted((r.sheet, r.first_row, r.last_row, r.first_col, r.last_col, r.header_rows, r.data_row) for r in t.collect())
    assert got == sorted(_plain(rows)) and len(got) > 10 and any(len(x[5]) > 1 for x in got)


def _deals(first, n, sheet="s", at=2):
    head = [(sheet, first, at + j, h) for j, h in enumerate(("Company", "Investment date", "Realized value", "Fund"))]
    return head + [(sheet, first + i, at + j, f"Company {i}" if j == 0 else "2020-01-31" if j == 1 else i * j) for i in range(1, n + 1) for j in range(4)]


def test_primary_table_of_whole_sheets(spark):
    """A table counts to its end, and one that begins below row 2,000 or right of column 300 is found."""
    none = spark.createDataFrame([], "file_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    cells = _cells(spark, _deals(1, 2600) + [("low", 2, 2, "Notes")] + _deals(3000, 40, "low") + _deals(1, 5, "right", at=400)).withColumn("sheet_idx", F.lit(0))
    found = discover.candidates(cells, none)
    got = {r.sheet: (r.first_row, r.rows, r.cols, r.sample_headers[:1], r.likely, r.density) for r in found.collect()}
    assert got == {"s": (1, 2600, 4, ["Company"], True, 1.0), "low": (3000, 40, 4, ["Company"], True, 1.0), "right": (1, 5, 4, ["Company"], True, 1.0)}
    first = discover.primary_tables(found.where("sheet <> 's'"), cells).first()
    assert (first.sheet, first.rows) == ("low", 40)


def test_merged_headers_below_the_scan(spark):
    rows = [x for x in _deals(3001, 8) if x[1:3] != (3001, 5)] + [("s", 3000, 4, "Entry")]
    merges = spark.createDataFrame([("f", "s", 3000, 3000, 4, 5)], "file_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    h = spark.createDataFrame([("f", "s", 1, 3000, 3009, 2, 5, 3002, [3000, 3001])], "file_id string, sheet string, block long, first_row int, last_row int, first_col int, last_col int, data_row int, header_rows array<int>")
    got = {r.col_no: r.header for r in discover.headers(_cells(spark, rows), merges, h).collect()}
    assert got == {2: "Company", 3: "Investment date", 4: "Entry | Realized value", 5: "Entry"}


def test_no_sheet_in_one_task(spark, tmp_path):
    """Windows over rows are parted by ranges; those over a whole sheet have a row a range or a few rows a block."""
    discover.row_summaries(_cells(spark, _deals(1, 30))).write.parquet(f"{tmp_path}/rows")
    seen, write = [], discover.saved
    try:
        discover.saved = lambda d, *name: seen.append(d._jdf.queryExecution().optimizedPlan().toString()) or write(d, *name)
        discover.in_tables(spark.read.parquet(f"{tmp_path}/rows")).count()
    finally:
        discover.saved = write
    rows = [m for plan in seen for m in re.findall(r"Window \[.*?\], \[(.*?)\], \[row_no", plan)]
    assert rows and all("__range" in m or "block" in m for m in rows)


def test_twin_of_the_primary_table_has_no_limit():
    from dealflow.plans import registry

    assert "1996" not in registry.ORACLE_SQL["B6_B12_primary"]


def test_cells_meet_few_tables(spark):
    """A1 on a sheet of many tables: each cell goes to its own, and is not compared with all of them."""
    rows = [(s, 20 * i + j, k, f"h{i}{k}" if j == 0 else 100 * i + 10 * j + k) for s in ("s", "t") for i in range(40) for j in range(9) for k in (2, 3, 4)] + [("s", 900, 2, 7), ("t", 5, 30, 1)]
    cells = _cells(spark, [(s, r + 1, k, v) for s, r, k, v in rows])
    t = discover.tables(cells).where("sheet = 's'")
    assert t.count() == 40
    none = spark.createDataFrame([], "file_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    d = discover.table_rows(cells, none, t)
    got = {r.row_no: r.vals for r in d.collect()}
    want = {20 * i + j + 1: {f"h{i}{k}": str(100 * i + 10 * j + k) for k in (2, 3, 4)} for i in range(40) for j in range(1, 9)}
    assert got == want | {901: {"h392": "7"}}
    assert "__of_range" in d._jdf.queryExecution().optimizedPlan().toString()


def test_row_summaries_are_hashed(spark):
    plan = discover.row_summaries(_cells(spark, _deals(1, 3)))
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {(r.row_no, r.kind, r.n, r.texts, r.nums) for r in plan.collect()} == {(1, "s", 4, 4, 0), *((i, "s", 4, 2, 2) for i in (2, 3, 4))}
