"""Quirks of scalars, matching, cleaning and discovery on inline tables."""

import datetime

from pyspark.sql import functions as F

from dealflow.functions import scalars as S
from dealflow.operators import clean, discover, matching, profile

D = datetime.date


def one(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_status(spark):
    assert one(spark, S.normalise_status, ["Partially realized", "Unrealised", "written off", "Sold", None, "?", "Exited", "current"]) == ["Unrealized", "Unrealized", "Realized", "Realized", "Unrealized", "Unrealized", "Realized", "Unrealized"]


def test_dates(spark):
    assert one(spark, S.to_date, ["2020-01-15", "31/12/2020", "12/31/2020", "31-12-2020", "2020/01/02", "2020-01-15 10:00:00", "-", "soon", None, ""]) == [D(2020, 1, 15), D(2020, 12, 31), D(2020, 12, 31), D(2020, 12, 31), D(2020, 1, 2), D(2020, 1, 15), None, None, None, None]


def test_numbers(spark):
    assert one(spark, S.to_number, ["1,234.5", "2.5x", "25%", "#DIV/0!", "abc", "", None, "NaN"]) == [1234.5, 2.5, 25.0, None, None, None, None, None]


def test_buckets(spark):
    assert one(spark, lambda v: S.bucket(v, "moic"), [1.0, 1.1, 3.0, 99.0, None, float("nan")], "double") == ["<=1.0x", "1.0x - 2.0x", "2.0x - 3.0x", ">=3.0x", "n/a", "n/a"]
    assert one(spark, lambda v: S.bucket(v, "hold"), [2.0, 3.0, 9.0, None], "double") == ["<=2 yrs", "2 yrs  - 4 yrs", ">=8 yrs", None]
    assert S.bucket_labels("entry_margin") == ["<=20%", "20% - 30%", "30% - 40%", "40% - 50%", ">=50%"]
    assert S.bucket_labels("ic") == ["<=$250m", "$250 - $500m", "$500 - $1000m", "$1000 - $1250m", "$1250 - $1500m", ">=$1500m"]


def test_headers(spark):
    assert one(spark, matching.norm, ["Gross MOIC(f)", "Café | Name (12)", "EV / EBITDA"]) == ["gross moic", "cafe name", "ev ebitda"]
    assert one(spark, profile.unit, ["EBITDA(k)", "Revenue (EUR m)", "Sales ('000)", "Multiple (x)", "Name"]) == ["k", "EUR m", "k", "x", None]
    assert one(spark, matching.slug, ["GP / Two", "???"]) == ["gp_two", "unknown_gp"]


def columns(spark, names, **over):
    base = dict(rows=10, data_type="string", fill_rate=1.0, distinct=10, samples=["Acme", "Bolt Co"], looks_moic=False, looks_irr=False, looks_currency=False, looks_date=False, looks_identifier=False)
    rows = [("f", i, n, *({**base, **over.get(n.replace(" ", "_"), {})}.values())) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "file string, col_index int, col_name string, rows long, data_type string, fill_rate double, distinct long, samples array<string>, looks_moic boolean, looks_irr boolean, looks_currency boolean, looks_date boolean, looks_identifier boolean")


def test_mapping(spark):
    cols = columns(spark, ["Portfolio Company", "Investment Date", "Gross MOIC", "Revenue growth | Acquisition", "Company Website", "Mystery"], Company_Website=dict(samples=["www.a.com", "www.b.com"]), Investment_Date=dict(data_type="date", looks_date=True))
    got = {r.field_id: r for r in matching.mapping(cols).collect()}
    assert got["company"].col_name == "Portfolio Company" and got["entry_date"].col_name == "Investment Date" and got["gross_moic"].tier == "green"
    assert got["entry_rev"].status != "auto_confirmed" and len(got) == 33
    used = [r.col_index for r in got.values() if r.col_index is not None]
    assert len(used) == len(set(used))


def test_company_rescue(spark):
    cols = columns(spark, ["Currency in $M", "Total"], Total=dict(data_type="numeric"))
    got = {r.field_id: r for r in matching.mapping(cols).collect()}
    assert got["company"].col_name in (None, "Currency in $M")
    free = columns(spark, ["zzz qqq", "Total"], Total=dict(data_type="numeric"))
    assert {r.field_id: r.col_name for r in matching.mapping(free).collect()}["company"] == "zzz qqq"


def test_greedy_ties(spark):
    s = spark.createDataFrame([("f", 0, "a", "x", 5, 0.9, []), ("f", 0, "a", "y", 1, 0.9, []), ("f", 1, "b", "y", 1, 0.8, []), ("f", 1, "b", "x", 5, 0.7, []), ("f", 2, "c", "z", 9, 0.4, [])], "file string, col_index int, col_name string, field_id string, field_ord int, confidence double, signals array<string>")
    assert sorted((r.field_id, r.col_name) for r in matching.resolve(s).collect()) == [("x", "b"), ("y", "a")]


def test_notes(spark):
    texts = ["Total", "Grand total", "* Please refer to …", "Acme Total Ltd", "Source:x", "- note", None]
    assert one(spark, clean.is_annotation, texts) == [True, True, True, False, True, True, False]
    assert one(spark, clean.is_note_header, ["Notes:", "(1) note", "All Investments Since 2012", "Fund VIII", "x (2001 - Present)"]) == [True, True, True, False, True]


def test_file_names(spark):
    names = ["GP_2 Data Sheet 2025.09.30.xlsx", "Alpha - Track Record 12.31.2025.xlsx", "Beta Portfolio Q3 2025.xlsx", "Gamma 2025 Q1.xlsx", "31.12.2024 report.xlsx"]
    assert one(spark, discover.gp_from_file_name, names)[:4] == ["GP_2", "Alpha", "Beta", "Gamma"]
    assert one(spark, discover.date_from_file_name, names) == [D(2025, 9, 30), D(2025, 12, 31), D(2025, 9, 30), D(2025, 3, 31), D(2024, 12, 31)]
    assert one(spark, discover.text_date, ["31 Dec 2024", "Dec 31, 2024", "Q2 2025", "x"]) == [D(2024, 12, 31), D(2024, 12, 31), D(2025, 6, 30), None]


def grid(spark, table, sheet="S", state="visible"):
    rows = [("f", "f.xlsx", sheet, 0, state, r, k, str(v), "n" if isinstance(v, (int, float)) else "s") for r, line in enumerate(table, 1) for k, v in enumerate(line, 1) if v is not None]
    return spark.createDataFrame(rows, "file_id string, file_name string, sheet string, sheet_idx int, sheet_state string, row_no int, col_no int, value string, vtype string")


def test_blocks_and_merged_headers(spark):
    table = [["Deals", None, None], [None] * 3, ["Company", "Entry", None], [None, "Revenue", "EBITDA"], ["A", 1, 2], ["B", 3, 4], [None] * 3, ["C", 5, 6]] + [[None] * 3] * 5 + [["x", 1, 2], ["y", 1, 2], ["z", 2, 3]]
    cells = grid(spark, table)
    merges = spark.createDataFrame([("f", "S", 3, 3, 2, 3)], "file_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    b = discover.blocks(cells).orderBy("first_row").collect()
    assert [(r.first_row, r.last_row) for r in b] == [(1, 8), (14, 16)]
    h = discover.header_rows(cells, discover.blocks(cells).where("first_row = 1"))
    assert h.first().header_rows == [1, 3, 4]
    names = [r.header for r in discover.headers(cells, merges, h).orderBy("col_no").collect()]
    assert names == ["Deals | Company", "Entry | Revenue", "Entry | EBITDA"]


def test_fund_labels(spark):
    tabs = spark.createDataFrame([("f", "Fund XI - Deal Data"), ("f", "Fund XII - Deal Data"), ("g", "Fund A"), ("g", "Fund B")], "file string, sheet string")
    assert sorted(r.fund_label for r in profile.fund_labels(tabs).collect()) == ["Fund A", "Fund B", "Fund XI", "Fund XII"]


def test_table_rows_below_the_scan(spark):
    """A1 reads on below the rows that discovery scans, past sparse and blank rows."""
    schema = "file_id string, sheet string, row_no int, col_no int, value string, vtype string"
    rows = [("f", "s", 1, k, v, "s") for k, v in ((1, "Company"), (2, "Fund"), (3, "Cost"))]
    rows += [("f", "s", i, k, v, t) for i in range(2, 2501) if i != 2100 for k, v, t in ((1, f"c{i}", "s"), (2, "7", "n"), (3, str(i), "n"))]
    cells = spark.createDataFrame(rows, schema)
    merges = spark.createDataFrame([], "file_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    got = {r.row_no: r.vals for r in discover.table_rows(cells, merges, discover.header_rows(cells, discover.blocks(cells))).collect()}
    assert set(got) == set(range(2, 2501)) - {2100} and got[2500] == {"Company": "c2500", "Fund": "7", "Cost": "2500"}


def landed(spark, sheets):
    """Cells of {sheet: (state, {(row, col): value})}; numbers and ISO dates get their kinds."""
    kind = lambda v: "n" if isinstance(v, (int, float)) else "d" if isinstance(v, D) else "s"
    rows = [("f", "Beta Portfolio Q3 2025.xlsx", s, i, state, r, k, str(v), kind(v)) for i, (s, (state, cells)) in enumerate(sheets.items()) for (r, k), v in cells.items()]
    return spark.createDataFrame(rows, "file_id string, file_name string, sheet string, sheet_idx int, sheet_state string, row_no int, col_no int, value string, vtype string")


def table(first, rows, cols=4, at=2):
    return {(first + i, at + j): (f"Company {i}" if j == 0 else D(2020, 1, 1 + i) if j == 1 else 10 * i + j) for i in range(rows) for j in range(cols)}


def test_grid_gaps_and_merged_headers(spark):
    """Two header rows with a merged group; four blank rows stay inside a table, five part two."""
    head = {(4, 4): "Entry", (5, 2): "Company", (5, 3): "Date", (5, 4): "Revenue", (5, 5): "EBITDA"}
    gaps = {**head, **table(6, 3), **table(13, 3), (21, 2): "Company", (21, 3): "Date", (21, 4): "Status", (21, 5): "Status", **table(22, 3)}
    cells = landed(spark, {"Gaps": ("visible", gaps)})
    merges = spark.createDataFrame([("f", "Gaps", 4, 4, 4, 5)], "file_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    b = discover.blocks(cells)
    assert sorted((r.first_row, r.last_row, r.first_col, r.last_col) for r in b.collect()) == [(4, 15, 2, 5), (21, 24, 2, 5)]
    h = discover.header_rows(cells, b)
    assert sorted((r.first_row, r.header_rows) for r in h.collect()) == [(4, [4, 5]), (21, [21])]
    names = {(r.block, r.col_no): r.header for r in discover.headers(cells, merges, h).collect()}
    assert [v for _, v in sorted(names.items())] == ["Company", "Date", "Entry | Revenue", "Entry | EBITDA", "Company", "Date", "Status", "Status.1"]
    rows = discover.table_rows(cells, merges, h).collect()
    assert len(rows) == 9 and {r.vals["Entry | Revenue"] for r in rows if r.row_no < 20} == {"2", "12", "22"}


def test_grid_turned_wide_and_hidden(spark):
    """A transposed table, a wide sparse sheet, and a hidden sheet whose banner does not count."""
    turned = {(1, 2): "Company", (1, 3): "Alpha", (1, 4): "Beta", (1, 5): "Gamma"} | {(r, k): (f"Metric {r}" if k == 2 else r * k) for r in range(2, 8) for k in range(2, 6)}
    wide = {(r, k): (f"Header {k}" if r == 1 else r * k) for r, n in ((1, 15), (2, 15), (3, 15), (4, 14)) for k in range(1, n + 1)} | {(9, 120): "end"}
    hidden = {(1, 1): "As of 31/12/2020", (2, 1): "USD in thousands"} | {(r + 3, k): v for (r, k), v in turned.items()}
    shown = {(1, 2): "As of 30/06/2024", (2, 2): "USD in millions", **{(4, k): f"Company {k}" for k in range(2, 5)}, **table(5, 4, cols=3)}
    cells = landed(spark, {"Shown": ("visible", shown), "Turned": ("visible", turned), "Wide": ("visible", wide), "Old": ("hidden", hidden)})
    none = spark.createDataFrame([], "file_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    found = {r.sheet: r for r in discover.candidates(cells, none).collect()}
    assert found["Turned"].orientation == "col_per_record" and found["Shown"].orientation == "row_per_record"
    assert sorted(r.row_no for r in discover.dense_rows(cells).where("sheet = 'Wide'").collect()) == [1, 2, 3]
    assert [tuple(r) for r in discover.track_record_dates(cells).collect()] == [("f", D(2024, 6, 30))]
    assert [tuple(r) for r in discover.unit_banner(cells).collect()] == [("f", "m")]
    assert "Old" not in {r.sheet for r in discover.visible(cells).select("sheet").distinct().collect()}


def test_layouts(spark):
    """Sheets of one layout are a fund each; a sheet of other columns is not."""
    like = {(1, k): h for k, h in zip(range(2, 6), ("Portfolio company", "Investment date", "Invested capital", "Realized value"))} | table(2, 5)
    other = {(1, k): f"Other {k}" for k in range(2, 12)} | table(2, 5, cols=10)
    none = spark.createDataFrame([], "file_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    for sheets, want in (({"Fund 1": like, "Fund 2": like, "Else": other}, ("per_fund", ["Fund 1", "Fund 2"])), ({"Fund 1": like, "Else": other}, ("consolidated", ["Fund 1"]))):
        cells = landed(spark, {s: ("visible", x) for s, x in sheets.items()})
        got = discover.layouts(discover.candidates(cells, none), cells).collect()
        assert [(r.layout, r.sheets) for r in got] == [want]


def test_snapshot_nulls(spark, tmp_path):
    """Undated snapshots and publications without a time stay where there is nothing newer."""
    from dealflow.operators import snapshots as A

    d = spark.createDataFrame([("A", None, None, 1), ("A", None, "2020-01-01 00:00:00", 2), ("B", "2019-01-01", None, 3), ("B", None, None, 4), ("C", None, None, 5), (None, None, None, 6)], "gp_name string, day string, at string, n int")
    d = d.select("gp_name", F.col("day").cast("date").alias("track_record_date"), F.col("at").cast("timestamp").alias("published_at"), "n")
    assert sorted(r.n for r in A.latest(d).collect()) == [1, 2, 3, 5, 6]
    assert sorted(r.n for r in A.newest(d).collect()) == [2, 3, 4, 5, 6]


def test_ingest_keeps_equal_deals(spark, tmp_path):
    """Equal deals of one snapshot stay; a replay and an older publication change nothing."""
    from dealflow.operators import snapshots as A
    from dealflow.streaming.ingest import ingest

    new = lambda at, *ids: A.long_table(spark.createDataFrame([(i, "G", None) for i in ids], "deal_id long, gp_name string, fund_currency string"), "2020-01-31", "me", at)
    for k, part in enumerate((new("2021-01-02 00:00:00", 1, 1, 2), new("2021-01-02 00:00:00", 1, 1, 2), new("2021-01-01 00:00:00", 9))):
        part.write.parquet(f"{tmp_path}/in{k}")
        ingest(spark, f"{tmp_path}/in{k}", f"{tmp_path}/s", f"{tmp_path}/state{k}", part.schema).awaitTermination()
        assert sorted(r.deal_id for r in A.read_snapshots(spark, f"{tmp_path}/s").collect()) == [1, 1, 2]


def test_similarity_fills_gaps(spark):
    """Vectors change the mapping of columns whose names say nothing, and of no other; far and broken vectors do nothing."""
    cols = columns(spark, ["Gross MOIC", "zzz", "qqq", "www"], **{n: dict(data_type="numeric") for n in ("Gross_MOIC", "zzz", "qqq", "www")})
    vectors = spark.createDataFrame([("f", 0, [0.0, 1.0]), ("f", 1, [1.0, 0.1]), ("f", 2, [-1.0, 0.0]), ("f", 3, [0.0, 0.0]), ("f", 3, None)], "file string, col_index int, vector array<double>")
    fields = spark.createDataFrame([("sector", [2.0, 0.0]), ("gross_irr", [0.0, 3.0]), ("region", [0.0, 0.0])], "field_id string, field_vector array<double>")
    chosen = lambda m: {r.field_id: r.col_name for r in m.collect() if r.col_name}
    assert chosen(matching.mapping(cols)) == {"gross_moic": "Gross MOIC"}
    assert chosen(matching.mapping(cols, (vectors, fields))) == {"gross_moic": "Gross MOIC", "sector": "zzz"}


def test_greedy_over_wide_files(spark):
    """Each field's best 33 columns are enough: 5,000 columns a file, with ties, as if all pairs were walked through."""
    import random

    r = random.Random(8)
    rows = [(f, k, f"c{k}", matching.FIELD_IDS[i], i, r.choice([0.5, 0.7, 0.9, round(r.random(), 2)])) for f in ("a", "b") for k in range(5000) for i in r.sample(range(33), 4)]
    d = spark.createDataFrame(rows, "file string, col_index int, col_name string, field_id string, field_ord int, confidence double").withColumn("signals", F.array(F.lit("x")))
    want, seen = [], set()
    for f, k, _, field, i, x in sorted(rows, key=lambda t: (t[0], -t[5], t[4], t[1])):
        if x >= 0.5 and (f, field) not in seen and (f, k) not in seen:
            seen |= {(f, field), (f, k)}
            want.append((f, field, k, x))
    assert sorted((x.file, x.field_id, x.col_index, x.confidence) for x in matching.resolve(d).collect()) == sorted(want) and len(want) == 66


def test_no_stored_mapping(spark, tmp_path):
    assert matching.load_mapping(spark, f"{tmp_path}/none").count() == 0 and matching.load_mapping(spark, f"{tmp_path}/none", "Alpha").columns == ["slug", "file", "field_id", "column"]


def test_names_dates_and_currencies(spark):
    """Five names after the file's own, each once, whatever its sheet repeats; B18: the banner's first date where nothing else gives one; B23: the currency column."""
    many = {(1 + k // 20, 1 + k % 20): "Same Name" for k in range(200)}
    cells = landed(spark, {"One": ("visible", many), "Two": ("visible", {(1, 1): "Other House", (2, 1): "Third House", (3, 1): "Other House"}), "Gone": ("hidden", {(1, 1): "Hidden House"})})
    assert discover.metadata(cells).first().gp_names == ["Beta", "Same Name", "Other House", "Third House"]
    bare = cells.withColumn("file_name", F.lit("n.xlsx"))
    assert discover.track_record_dates(bare).first().as_of is None
    dated = landed(spark, {"One": ("visible", {(3, 2): "12/31/2021", (2, 9): D(1980, 1, 1), (4, 1): D(2022, 5, 5)}), "Two": ("visible", {(1, 1): D(2020, 2, 2)})}).withColumn("file_name", F.lit("n.xlsx"))
    assert [tuple(r) for r in discover.track_record_dates(dated).collect()] == [("f", D(2021, 12, 31))]
    none = spark.createDataFrame([], "file_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    own = {(3, 2): "Company", (3, 3): "Old currency", (3, 4): "Deal Currency", (3, 5): "Status"} | {(r, k): v for r in range(4, 9) for k, v in ((2, f"C{r}"), (4, "EUR" if r > 5 else None), (5, r)) if v} | {(1, 2): "Alpha Capital Data"} | {(r, k): f"H{k}" if r == 3 else r * k for r in range(3, 9) for k in range(6, 14)}
    cells = landed(spark, {"Own": ("visible", own), "Usd": ("visible", {(1, 2): "Company", (1, 3): "Date", (1, 4): "Status", **table(2, 4, cols=3)})})
    h = discover.tables(cells)
    got = {r.sheet: r for r in discover.banner_meta(cells, h, discover.headers(cells, none, h)).collect()}
    assert got["Own"].currency == "EUR" and got["Own"].gp_name == "Alpha Capital" and got["Usd"].currency == "USD"


def test_primary_by_score(spark):
    """The highest score wins, likely or not; B13 goes by the first 15 headers."""
    deal = {(1, 2): "Company", (1, 3): "Investment date", (1, 4): "Realized value", (1, 5): "Fund"} | table(2, 4)
    wide = {(1, k): f"Other {k}" for k in range(2, 14)} | table(2, 30, cols=12)
    none = spark.createDataFrame([], "file_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    cells = landed(spark, {"Deals": ("visible", deal), "Wide": ("visible", wide)})
    found = discover.candidates(cells, none)
    assert {r.sheet: r.likely for r in found.collect()} == {"Deals": True, "Wide": False}
    assert discover.primary_tables(found, cells).first().sheet == "Wide"
    assert [(r.layout, r.sheets) for r in discover.layouts(found, cells).collect()] == [("consolidated", ["Wide"])]
    head = ("Company", "Investment date", "Realized value", "Fund")
    far = lambda tail: {(1, k): head[k - 2] if k < 6 else f"Field {k}" if k < 17 else f"{tail} {k}" for k in range(2, 22)} | table(2, 5, cols=20)
    cells = landed(spark, {"A": ("visible", far("left")), "B": ("visible", far("right"))})
    assert discover.layouts(discover.candidates(cells, none), cells).first().layout == "per_fund"


def test_input_grid(spark):
    """A2: the meta block by labels, headers up to the first gap, rows up to the first one that is blank under them."""
    from dealflow.operators import validate  # noqa: F401

    g = {(3, 2): "GP  Name", (3, 3): " Alpha ", (4, 2): "Track Record Date", (4, 3): "31/12/2020", (5, 2): "Currency", (5, 3): "EUR", (16, 2): "GP Name", (16, 3): "Too low"}
    g |= {(20, 2): "Company", (20, 3): "Fund\n Name", (20, 5): "Beyond the gap", (21, 2): "A", (21, 3): "F", (22, 3): "G", (23, 5): "stray", (23, 9): "stray", (24, 2): "after"}
    cells = landed(spark, {"S": ("visible", g)})
    assert [tuple(r) for r in discover.input_meta(cells).collect()] == [("f", "Alpha", D(2020, 12, 31), "EUR")]
    assert sorted(tuple(r)[1:] for r in discover.input_grid(cells).collect()) == [(21, "Company", "A"), (21, "Fund Name", "F"), (22, "Fund Name", "G")]
    assert sorted(r.header for r in discover.input_headers(cells).collect()) == ["Company", "Fund Name"]
    bare = landed(spark, {"S": ("visible", {(1, 1): "x"})})
    assert [tuple(r) for r in discover.input_meta(bare).collect()] == [("f", None, None, None)] and discover.input_grid(bare).count() == 0
