"""Scans by ranges, medians by counting and tables by rows give what whole groups give."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from dealflow.operators import clean, discover, medians, segments, validate


@pytest.mark.parametrize("width", [1, 7, 59, 10**9])
def test_sections_by_ranges(spark, width):
    """E4 over one file of many ranges, with banners far above, in other ranges and in other tabs."""
    r = random.Random(width)
    rows, want = [], []
    for file, tab in (("f", "a"), ("f", "b"), ("f", None), ("g", "a")):
        section, at = None, 0
        for _ in range(300):
            at += r.choice([1, 1, 2, 40])
            if file == "f" and r.random() < 0.02:
                section = f"Fund {at}"
                rows.append((file, tab, at, f"{section} (vintage 2005)", None, None))
            else:
                rows.append((file, tab, at, f"Company {at}", None if file == "f" else "Own", "12"))
                want.append((file, str(tab), at, (section or tab) if file == "f" else "Own"))
    d = spark.createDataFrame(rows, "file string, tab string, row_no int, company string, fund string, total_ic string").repartition(3)
    got = clean.inherit_sections(d, ["fund", "total_ic"], width)
    assert got.columns == d.columns
    assert sorted((x.file, str(x.tab), x.row_no, str(x.fund)) for x in got.collect()) == sorted((*x[:3], str(x[3])) for x in want)


@pytest.mark.parametrize("width", [1, 7, 10**9])
def test_runs_by_ranges(spark, width):
    r = random.Random(5)
    rows, want = [], []
    for key in ("a", None):
        at, run = 0, 0
        for i in range(200):
            step = r.choice([1, 1, 5, 6, 30])
            run += i == 0 or step > 5
            at += step
            rows.append((key, at))
            want.append((str(key), at, run))
    d = spark.createDataFrame(rows, "k string, row_no int").repartition(3)
    assert sorted((str(x.k), x.row_no, x.run) for x in segments.runs(d, ["k"], "row_no", 4, "run", width).collect()) == sorted(want)


def test_medians(spark):
    r = random.Random(2)
    values = {"even": [r.random() for _ in range(400)], "odd": [r.lognormvariate(0, 9) for _ in range(333)], "ties": [1.0] * 300 + [2.0] * 300, "one": [7.5], "far": [-1.7e308, 1.7e308, 3.0], "near": [1.0, 1.0 + 2**-52] * 50, None: [4.0, -4.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("even", None), ("none", None), ("odd", float("nan"))]
    d = spark.createDataFrame(rows, "k string, v double").repartition(4)
    want = {k: statistics.median(vs) for k, vs in values.items()}
    for bins, few in ((3, 2), (4096, 10000)):
        got = {x.k: x.median for x in medians.medians(d, ["k"], F.col("v"), bins=bins, few=few).collect()}
        assert got == pytest.approx(want, rel=1e-12)
    every = statistics.median([v for vs in values.values() for v in vs])
    assert medians.medians(d, [], F.col("v"), bins=5, few=3).first().median == pytest.approx(every)
    assert medians.medians(d.where("false"), ["k"], F.col("v")).count() == 0


def test_first_bad_cells(spark):
    d = spark.range(40).selectExpr("'f' AS file", "CAST(id AS INT) AS row_no", "'c' AS company", "'f' AS fund", "'Realized' AS status", "IF(id % 3 = 0, 'x', '1') AS total_ic", "'y' AS realized", "'1' AS current_value", "'1' AS gross_tvpi", "'1' AS gross_irr", "'soon' AS entry_date", "'' AS exit_date")
    meta = spark.sql("SELECT 'f' AS file, 'G' AS gp_name, DATE '2020-01-01' AS as_of, 'USD' AS currency UNION ALL SELECT 'none', 'G', DATE '2020-01-01', 'USD'")
    got = {x.file: x for x in validate.gate(d.repartition(3), meta).collect()}
    assert got["f"].first_bad_numbers == "total_ic row 0; realized row 0; realized row 1; realized row 2; total_ic row 3; realized row 3; realized row 4; realized row 5"
    assert got["f"].bad_numbers == 54 and got["f"].first_bad_dates.count(";") == 7 and got["none"].rows == 0 and got["none"].decision == 1


def test_many_blocks(spark):
    """B4 where a sheet has hundreds of blocks: each row knows its own."""
    d = spark.range(300).selectExpr("id", "explode(array(0, 1, 2)) AS step").selectExpr("'f' AS file_id", "'s' AS sheet", "step + CAST(id AS INT) * 6 + 1 AS row_no").selectExpr("*", "explode(array(1, 2, 3)) AS col_no", "'x' AS value", "'s' AS vtype")
    b = discover.blocks(d.where("row_no <= 1800")).orderBy("first_row").collect()
    assert len(b) == 1  # gaps of three rows
    b = discover.blocks(d.where("row_no <= 1800"), gap=2).orderBy("first_row").collect()
    assert [(x.first_row, x.last_row) for x in b] == [(6 * i + 1, 6 * i + 3) for i in range(300)]


@pytest.mark.parametrize("width", [1, 59, 10**9])
def test_blocks_by_ranges(spark, width):
    """B4 by ranges gives the blocks of the windows, gaps and sparse rows included, and goes on below the scan."""
    r = random.Random(3)
    rows, at = [], 0
    for _ in range(400):
        at += r.choice([1, 1, 1, 1, 4, 7])
        rows += [("f", s, at, k) for s in ("s", "t") for k in range(2, 2 + r.choice([1, 9, 10, 12]))]
    d = spark.createDataFrame(rows, "file_id string, sheet string, row_no int, col_no int").selectExpr("*", "'x' AS value", "'s' AS vtype").repartition(3)
    key = lambda b: sorted((x.sheet, x.first_row, x.last_row, x.first_col, x.last_col) for x in b.collect())
    assert key(discover.blocks_by_ranges(d, width=width)) == key(discover.blocks(d)) != []
    low = d.withColumn("row_no", F.col("row_no") + 5000)
    assert len(key(discover.blocks_by_ranges(low, width=width))) == len(key(discover.blocks(d))) and key(discover.blocks(low)) == []


def test_numbers_by_ranges(spark):
    from dealflow.operators.segments import numbered

    rows = [(g, f, i) for g in "ab" for f in "xy" for i in range(0, 60, 3 if g == "a" else 7)]
    d = spark.createDataFrame(rows[::-1], "g string, f string, i long")
    want = {}
    for g, f, i in sorted(rows):
        want[g, f, i] = 1 + sum(k[0] == g for k in want)
    for width in (1, 10, 1000):
        assert {(r.g, r.f, r.i): r.n for r in numbered(d, ["g"], ["f"], "i", "n", width=width).collect()} == want


def test_first_rows_by_ranges(spark):
    from dealflow.operators.segments import first_rows

    d = spark.createDataFrame([(g, i * i) for g in ("a", None) for i in range(30)] + [("few", 5)], "g string, i long")
    for width in (1, 10, 1000):
        got = sorted((str(r.g), r.k, r.i) for r in first_rows(d, ["g"], "i", 4, width).collect())
        assert got == sorted([(g, k + 1, k * k) for g in ("a", "None") for k in range(4)] + [("few", 1, 5)])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _window_keys(df):
    """Partition keys of each window of the plan, without their numbers."""
    import re

    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"Window \[row_number\(\).*?\], \[(.*?)\], \[", _plan(df))]


def test_no_window_over_a_whole_file(spark, sf):
    from dealflow.sources import fixtures as X

    # A file, or a fund of one, is a fifth or a twenty-fifth of all deals; their rows are numbered by ranges.
    for rows in (X.deals_text(spark, sf).select("deal_id", "row_no"), X.raw_rows(spark, sf).select("row_no", "company"), X.landed_cells(spark, sf).select("row_no", "value"), X.input_cells(spark, sf).select("row_no", "value")):
        keys = _window_keys(rows)
        assert keys and all("__range" in k for k in keys)


def test_profiles_count_distinct_values_without_the_other_aggregates(spark):
    from dealflow.operators.profile import column_profiles

    d = spark.createDataFrame([("f", 0, "c", i, str(i % 3) if i else None) for i in range(20)], "file string, col_index int, col_name string, row_no long, value string")
    p = column_profiles(d)
    assert "partial_count(distinct" not in _plan(p) and "count(distinct" not in _plan(p)
    row = p.first()
    assert (row.distinct, row.samples) == (3, [str(i % 3) for i in range(1, 11)])
    blank = column_profiles(spark.createDataFrame([("f", 0, "c", 1, None)], d.schema)).first()
    assert (blank.distinct, blank.samples, blank.data_type) == (0, None, "empty")


def test_table_rows_shuffle_cells_without_headers(spark):
    from dealflow.operators import discover as B
    from dealflow.sources.fixtures import landed_merges

    cells = [("f", "s", r, k, f"h{k}" if r == 1 else str(r * k), "s" if r == 1 else "n") for r in range(1, 6) for k in (1, 2, 3) if (r, k) != (3, 2)]
    cells = spark.createDataFrame([*cells, ("f", "s", 4, 9, "aside", "s")], "file_id string, sheet string, row_no int, col_no int, value string, vtype string")
    h = spark.createDataFrame([("f", "s", 1, 1, 5, 1, 3, 2, [1])], "file_id string, sheet string, block long, first_row int, last_row int, first_col int, last_col int, data_row int, header_rows array<int>")
    got = B.table_rows(cells, landed_merges(spark), h)
    assert {r.row_no: r.vals for r in got.collect()} == {r: {f"h{k}": str(r * k) for k in (1, 2, 3) if (r, k) != (3, 2)} for r in range(2, 6)}
    assert _plan(got).count("SortMergeJoin") == 0


def test_snapshots_hold_what_is_known_and_derive_the_rest(spark, sf):
    from dealflow.plans import quality_queries as A

    stored = A._store(spark, sf).read()
    assert "total_ic" in stored.columns and not {"gross_moic", "hold_period", "moic_bucket", "entry_margin"} & set(stored.columns)
    assert {"gross_moic", "hold_period", "moic_bucket", "entry_margin"} <= set(A.published(spark, sf).columns)
