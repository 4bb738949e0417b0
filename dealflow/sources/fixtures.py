"""Deal tables derived from the driver's star schema, as inputs of the registered queries.

DEALS_SQL is plain SQL that Spark and DuckDB both run, so that queries and their SQL twins start from the same
deals; everything computed from them is written twice, as DataFrame code and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.segments import numbered
from .shared import saved

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")

DEALS_SQL = """
SELECT o.o_orderkey AS deal_id,
  'GP_' || r.r_name AS gp_name,
  c.c_name AS company,
  CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE r.r_name || ' Fund ' || c.c_mktsegment END AS fund,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN '1,234' END AS fund_currency,
  CASE WHEN o.o_orderkey % 10 = 3 THEN NULL ELSE p.p_type END AS sector,
  n.n_name AS geography,
  CAST(o.o_orderdate AS DATE) - CAST((o.o_orderkey % 4) * 730 AS INT) AS entry_date,
  CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.last_ship AS DATE) END AS exit_date,
  CASE o.o_orderstatus WHEN 'F' THEN 'Fully Realised' WHEN 'P' THEN 'Partially realized' ELSE 'Active' END AS status,
  o.o_orderpriority AS transaction_type,
  CASE WHEN o.role <> 'N' THEN o.role END AS gp_role,
  p.p_brand AS process_type,
  'Supplier ' || CAST(o.supp AS VARCHAR(20)) AS sourcing_partner,
  CASE WHEN o.o_orderstatus = 'F' AND o.last_ship IS NOT NULL THEN c.c_mktsegment END AS exit_type,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'N' END AS coi,
  CAST(0.8 * abs(o.ic) AS DECIMAL(24,7)) AS ic_initial,
  o.ic AS total_ic,
  CAST(0.004 * o.done AS DECIMAL(24,7)) AS realized,
  CAST(0.004 * o.open AS DECIMAL(24,7)) AS current_value,
  CAST(CASE WHEN o.o_orderkey % 101 = 0 THEN 150 WHEN o.o_orderkey % 5 = 0 THEN (o.o_orderkey % 40) * 0.1 END AS DECIMAL(24,7)) AS gross_tvpi,
  CAST(CASE WHEN o.o_orderkey % 97 = 0 THEN 25 WHEN o.o_orderkey % 11 <> 0 THEN (o.o_orderkey % 61 - 20) * 0.01 END AS DECIMAL(24,7)) AS gross_irr,
  CAST(o.quantity * 12 AS DECIMAL(24,7)) AS entry_rev,
  o.ebitda AS entry_ebitda,
  CAST(o.quantity * 30 AS DECIMAL(24,7)) AS entry_net_debt,
  CAST(o.ebitda * (p.p_size % 25) AS DECIMAL(24,7)) AS entry_ev,
  CAST(o.quantity * 12 * (1 + (o.o_orderkey % 7 - 2) * 0.1) AS DECIMAL(24,7)) AS exit_rev,
  o.exit_ebitda AS exit_ebitda,
  CAST(o.quantity * 20 AS DECIMAL(24,7)) AS exit_net_debt,
  CAST(o.exit_ebitda * (p.p_size % 20) AS DECIMAL(24,7)) AS exit_ev,
  CASE o.o_orderkey % 3 WHEN 0 THEN '-' WHEN 1 THEN 'None' ELSE 'Multiples' END AS valuation_method,
  CAST(o.o_orderkey % 111 AS INT) AS fund_ownership,
  CAST(o.o_orderkey % 45 AS INT) AS holding_period,
  CAST(o.o_orderkey % 6 AS INT) AS no_of_seats
FROM (SELECT d.*,
    CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN 0.6 WHEN o_orderkey % 53 = 0 THEN -0.004 * CAST(o_totalprice AS DECIMAL(18,4)) ELSE 0.004 * CAST(o_totalprice AS DECIMAL(18,4)) END AS DECIMAL(24,7)) AS ic,
    CAST((CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE 1 END) * CAST(quantity AS DECIMAL(12,4)) * 12 * (0.10 + 2 * CAST(tax AS DECIMAL(8,4))) AS DECIMAL(24,7)) AS ebitda,
    CAST((CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE 1 END) * CAST(quantity AS DECIMAL(12,4)) * 12 * (0.10 + 2 * CAST(tax AS DECIMAL(8,4))) * (1 + (o_orderkey % 5 - 1) * 0.1) AS DECIMAL(24,7)) AS exit_ebitda
  FROM (SELECT o1.*, li.* FROM {orders} o1
    LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship, min(l_returnflag) AS role, min(l_suppkey) AS supp, min(l_partkey) AS part,
      CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS quantity, CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS tax,
      CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(1 - l_discount AS DECIMAL(6,4)) ELSE 0 END) AS DECIMAL(20,4)) AS done,
      CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(1 - l_discount AS DECIMAL(6,4)) ELSE 0 END) AS DECIMAL(20,4)) AS open
    FROM {lineitem} GROUP BY l_orderkey) li ON o1.o_orderkey = li.l_orderkey) d) o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN {part} p ON o.part = p.p_partkey
"""


def deals_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-A: one row for each order, as a deal."""
    return spark.sql(DEALS_SQL, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


#: Key, manager and fund of each deal, as in DEALS_SQL.
IDS_SQL = """
SELECT o.o_orderkey AS deal_id, 'GP_' || r.r_name AS gp_name, CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE r.r_name || ' Fund ' || c.c_mktsegment END AS fund
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""


def deal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deals' keys, managers and funds alone: what it takes to number deals."""
    return spark.sql(IDS_SQL, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation", "region")})


def deals_sql() -> str:
    return DEALS_SQL.format(**{t: t for t in TABLES})


#: F-B and F-H: the same deals as text with mixed formats, with row numbers in files by manager and fund.
TEXT_SQL = """
SELECT deal_id, gp_name AS file, CAST(row_number() OVER (PARTITION BY gp_name ORDER BY deal_id) AS INT) AS row_no,
  CASE WHEN deal_id % 211 = 0 THEN ' ' ELSE company END AS company, fund, fund_currency, gp_name, sector,
  CASE deal_id % 6 WHEN 0 THEN e WHEN 1 THEN substr(e, 9, 2) || '/' || substr(e, 6, 2) || '/' || substr(e, 1, 4) WHEN 2 THEN substr(e, 9, 2) || '-' || substr(e, 6, 2) || '-' || substr(e, 1, 4)
    WHEN 3 THEN replace(e, '-', '/') WHEN 4 THEN e || ' 00:00:00' ELSE '-' END AS entry_date,
  CASE WHEN deal_id % 307 = 0 THEN 'soon' ELSE x END AS exit_date,
  CASE deal_id % 5 WHEN 1 THEN CASE WHEN total_ic >= 1000 THEN CAST(CAST(floor(total_ic / 1000) AS BIGINT) AS VARCHAR(20)) || ',' || lpad(CAST(CAST(floor(total_ic) AS BIGINT) % 1000 AS VARCHAR(20)), 3, '0') ELSE ic END WHEN 2 THEN 'n/a' WHEN 3 THEN '#DIV/0!' ELSE ic END AS total_ic,
  CAST(realized AS VARCHAR(40)) AS realized, CAST(current_value AS VARCHAR(40)) AS current_value,
  CASE WHEN gross_tvpi IS NULL THEN NULL WHEN deal_id % 2 = 0 THEN CAST(gross_tvpi AS VARCHAR(40)) || 'x' ELSE CAST(gross_tvpi AS VARCHAR(40)) END AS gross_tvpi,
  CASE WHEN deal_id % 3 = 0 THEN CAST(gross_irr * 100 AS VARCHAR(40)) || '%' ELSE CAST(gross_irr AS VARCHAR(40)) END AS gross_irr,
  CASE deal_id % 9 WHEN 0 THEN 'Unrealised' WHEN 1 THEN 'written off' WHEN 2 THEN 'sold' WHEN 3 THEN 'current' WHEN 4 THEN '' WHEN 5 THEN 'Realized' WHEN 6 THEN 'unrealized' ELSE status END AS status,
  coi, valuation_method
FROM (SELECT *, CAST(entry_date AS VARCHAR(20)) AS e, CAST(exit_date AS VARCHAR(20)) AS x, CAST(total_ic AS VARCHAR(40)) AS ic FROM {deals}) d
"""


#: The number of a deal in its file, which Spark takes from numbered().
ROW_NO = "CAST(row_number() OVER (PARTITION BY gp_name ORDER BY deal_id) AS INT)"


def deals_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-B. Rows are numbered by ranges; a window over a file would hold it in one task."""
    d = numbered(deals_raw(spark, sf_dir), ["gp_name"], [], "deal_id", "row_no", deal_ids(spark, sf_dir))
    return spark.sql(TEXT_SQL.replace(ROW_NO, "row_no"), deals=d)


def text_sql() -> str:
    return TEXT_SQL.format(deals=f"({deals_sql()}) z")


#: F-G: three publications of the deals known at a date; the last one of one manager is missing, one came twice.
SNAPSHOT_DATES = ("1997-12-31", "1999-12-31", "2001-12-31")


#: F-C: the deals as rows of text, with banners (in one file, which has no fund column), totals, notes, prose and blanks.
RAW_SQL = """
WITH d AS (SELECT file, 'Deals' AS tab, CAST(10 * row_number() OVER (PARTITION BY file ORDER BY coalesce(fund, ''), deal_id) AS INT) AS row_no, company, fund, entry_date, exit_date, sector, status, total_ic, realized, current_value, gross_tvpi, gross_irr FROM {text} t)
SELECT file, tab, row_no, company, CASE WHEN file = 'GP_ASIA' THEN NULL ELSE fund END AS fund, entry_date, exit_date, sector, status, total_ic, realized, current_value, gross_tvpi, gross_irr FROM d
UNION ALL SELECT file, tab, min(row_no) - 5, fund || ' (vintage 2005)', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM d WHERE file = 'GP_ASIA' AND fund IS NOT NULL GROUP BY file, tab, fund
UNION ALL SELECT file, tab, min(row_no) - 4, fund, fund, NULL, NULL, NULL, NULL, '-', NULL, NULL, NULL, NULL FROM d WHERE file <> 'GP_ASIA' AND fund IS NOT NULL GROUP BY file, tab, fund
UNION ALL SELECT file, tab, max(row_no) + 1, 'Grand total', NULL, NULL, NULL, NULL, NULL, '12', NULL, NULL, NULL, NULL FROM d GROUP BY file, tab
UNION ALL SELECT file, tab, max(row_no) + 2, '* Please refer to the notes', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM d GROUP BY file, tab
UNION ALL SELECT file, tab, max(row_no) + 3, 'Values are shown before fees and before any carry that is due', NULL, '-', NULL, NULL, NULL, 'n/a', NULL, NULL, NULL, NULL FROM d GROUP BY file, tab
UNION ALL SELECT file, tab, max(row_no) + 4, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM d GROUP BY file, tab
UNION ALL SELECT file, 'Copy', row_no, company, CASE WHEN file = 'GP_ASIA' THEN NULL ELSE fund END, entry_date, exit_date, sector, status, total_ic, realized, current_value, gross_tvpi, gross_irr FROM d WHERE row_no % 100 = 0
"""
#: All columns of F-C besides the company: a banner has none of them.
RAW_VALUES = tuple("fund, entry_date, exit_date, sector, status, total_ic, realized, current_value, gross_tvpi, gross_irr".split(", "))


#: The number of a row, which Spark takes from numbered().
RAW_NO = "CAST(10 * row_number() OVER (PARTITION BY file ORDER BY coalesce(fund, ''), deal_id) AS INT) AS row_no"


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-C."""
    by_fund = F.coalesce("fund", F.lit(""))
    ids = deal_ids(spark, sf_dir).select("deal_id", F.col("gp_name").alias("file"), by_fund.alias("__fund"))
    d = numbered(deals_text(spark, sf_dir).drop("row_no").withColumn("__fund", by_fund), ["file"], ["__fund"], "deal_id", "row_no", ids).withColumn("row_no", (F.col("row_no") * 10).cast("int"))
    return spark.sql(RAW_SQL.replace(RAW_NO, "row_no"), text=d)


def raw_sql() -> str:
    return RAW_SQL.format(text=f"({text_sql()})")


#: F-D, F-E: headers of the landed sheets over the columns of the text deals, by manager.
SHEET_HEADERS = (("company", "Portfolio Company (a)"), ("entry_date", "Investment Date"), ("exit_date", "Exit Date"), ("total_ic", "Invested Capital ($m)"), ("realized", "Realised Value"), ("gross_tvpi", "Gross MOIC"), ("sector", "Industry"), ("status", "Status"), ("geography", "Company Website"), ("current_value", "Unrealised Value"), ("entry_rev", "Revenue | Acquisition"), ("entry_ebitda", "EBITDA | Acquisition"), ("entry_ev", "Enterprise Value | Acquisition"))


def landed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-E: a sheet for each fund of each manager, with banner, header in row 4 and deals below; names carry dates."""
    d = numbered(deals_raw(spark, sf_dir).where("fund IS NOT NULL"), ["gp_name", "fund"], [], "deal_id", "__k", deal_ids(spark, sf_dir).where("fund IS NOT NULL"))
    d = d.withColumn("geography", F.concat(F.lit("www."), F.lower("geography"), F.lit(".com")))
    d = d.withColumns({"file_id": F.col("gp_name"), "sheet": F.concat("fund", F.lit(" - Deal Data")), "row_no": F.col("__k") + 4})
    # The number of a sheet joins its deals, not their cells; the list of sheets is short and written, so Spark knows its size.
    sheets = deal_ids(spark, sf_dir).where("fund IS NOT NULL").select(F.col("gp_name").alias("file_id"), F.concat("fund", F.lit(" - Deal Data")).alias("sheet")).distinct()
    order = saved(sheets.withColumn("sheet_idx", (F.row_number().over(Window.partitionBy("file_id").orderBy("sheet")) - 1).cast("int")), "sheets")
    d = d.join(order, ["file_id", "sheet"])
    kinds = {"entry_date": "d", "exit_date": "d", "total_ic": "n", "realized": "n", "gross_tvpi": "n", "current_value": "n", "entry_rev": "n", "entry_ebitda": "n", "entry_ev": "n"}
    cell = lambda i, x: F.struct(F.lit(i + 2).alias("col_no"), F.col(x).cast("string").alias("value"), F.lit(kinds.get(x, "s")).alias("vtype"))
    body = d.select("file_id", "sheet", "sheet_idx", "row_no", F.inline(F.array(*(cell(i, x) for i, (x, _) in enumerate(SHEET_HEADERS)))))
    top = [(1, 2, "Alpha Capital Track Record"), (2, 2, "As of 30/09/2025"), (2, 3, "USD in millions"), *((4, i + 2, h) for i, (_, h) in enumerate(SHEET_HEADERS))]
    head = F.array(*(F.struct(F.lit(r).alias("row_no"), F.lit(k).alias("col_no"), F.lit(v).alias("value"), F.lit("s").alias("vtype")) for r, k, v in top))
    cells = body.unionByName(order.select("file_id", "sheet", "sheet_idx", F.inline(head)))
    name = F.concat("file_id", F.lit(" Data Sheet 2025.09.30.xlsx"))
    return cells.where("value IS NOT NULL").withColumns({"file_name": name, "sheet_state": F.lit("visible")})


def landed_merges(spark: SparkSession) -> DataFrame:
    """No merged cells."""
    return spark.sql("SELECT '' AS file_id, '' AS sheet, 0 AS min_row, 0 AS max_row, 0 AS min_col, 0 AS max_col WHERE false")


#: F-H: deal-input rows by file. One file has a cell that is no number; statuses and the rest are clean.
INPUT_SQL = """
SELECT gp_name AS file, CAST(row_number() OVER (PARTITION BY gp_name ORDER BY deal_id) AS INT) AS row_no, company, fund, CASE WHEN status = 'Fully Realised' THEN 'Realized' ELSE 'Unrealized' END AS status,
  CAST(entry_date AS VARCHAR(20)) AS entry_date, CAST(exit_date AS VARCHAR(20)) AS exit_date, CASE WHEN gp_name = 'GP_MIDDLE EAST' AND deal_id % 17 = 0 THEN 'n/a' ELSE CAST(total_ic AS VARCHAR(40)) END AS total_ic,
  CAST(realized AS VARCHAR(40)) AS realized, CAST(current_value AS VARCHAR(40)) AS current_value, CAST(gross_tvpi AS VARCHAR(40)) AS gross_tvpi, CAST(gross_irr AS VARCHAR(40)) AS gross_irr FROM {deals} d
"""
#: Headers of the deal-input grid, by the columns of INPUT_SQL.
INPUT_HEADERS = {"company": "Company", "fund": "Fund", "status": "Status", "entry_date": "Entry Date", "exit_date": "Exit Date", "total_ic": "Total IC", "realized": "Realized", "current_value": "Current Value", "gross_tvpi": "Gross TVPI", "gross_irr": "Gross IRR"}
#: The meta block of each file; one lacks its name, one its date, one its currency.
INPUT_META = "SELECT file, CASE WHEN file <> 'GP_AFRICA' THEN file END AS gp_name, CASE WHEN file <> 'GP_AMERICA' THEN DATE '2001-12-31' END AS as_of, CASE WHEN file <> 'GP_ASIA' THEN 'USD' END AS currency FROM (SELECT DISTINCT file FROM {t}) q"
#: A blank row stands below this row of one file; what is below it is not read.
INPUT_END = ("GP_EUROPE", 100)


def input_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-H as grids: a meta block, headers in row 7 from column 2 on, deals below, and a remark right of the headers in the blank row."""
    d = numbered(deals_raw(spark, sf_dir), ["gp_name"], [], "deal_id", "row_no", deal_ids(spark, sf_dir))
    d = spark.sql(INPUT_SQL.replace(ROW_NO, "row_no"), deals=d)
    meta = spark.sql(INPUT_META, t=deal_ids(spark, sf_dir).withColumnRenamed("gp_name", "file"))
    cell = lambda r, k, v: F.struct(F.lit(r).cast("int").alias("row_no") if isinstance(r, int) else r.cast("int").alias("row_no"), F.lit(k).alias("col_no"), v.cast("string").alias("value"))
    top = [(3, "GP Name", "gp_name"), (4, "Track Record Date", "as_of"), (5, "Currency", "currency")]
    head = [cell(7, i + 2, F.lit(h)) for i, h in enumerate(INPUT_HEADERS.values())]
    block = meta.select("file", F.inline(F.array(*(x for r, label, value in top for x in (cell(r, 2, F.lit(label)), cell(r, 3, F.col(value)))), *head)))
    at = F.col("row_no") + 7 + F.when((F.col("file") == INPUT_END[0]) & (F.col("row_no") > INPUT_END[1]), 1).otherwise(0)
    body = d.select("file", F.inline(F.array(*(cell(at, i + 2, F.col(x)) for i, x in enumerate(INPUT_HEADERS)))))
    stray = meta.select("file", F.inline(F.array(cell(8 + INPUT_END[1], 40, F.lit("see notes")))))
    cells = block.unionByName(body).unionByName(stray).where("value IS NOT NULL")
    return cells.select(F.col("file").alias("file_id"), F.lit("Deal Level Inputs").alias("sheet"), F.lit(0).alias("sheet_idx"), "row_no", "col_no", "value", F.lit("s").alias("vtype"))


#: F-E2: a file for each nation with a sheet for each supplier, whose name, state and banner take many forms.
SHAPES_SQL = """
SELECT n.n_name AS file_id, n.n_name || CASE n.n_nationkey % 4 WHEN 0 THEN ' Data Sheet 2025.09.30.xlsx' WHEN 1 THEN ' Portfolio Q3 2025.xlsx' WHEN 2 THEN '.xlsx' ELSE ' - Track Record 12.31.2025.xlsx' END AS file_name, n.n_nationkey AS n, s.s_suppkey AS k,
  CASE s.s_suppkey % 6 WHEN 0 THEN 'Deals ' WHEN 1 THEN 'Summary ' WHEN 2 THEN 'Sheet' WHEN 4 THEN 'Track Record ' ELSE 'Fund ' END || CAST(s.s_suppkey AS VARCHAR(20)) || CASE s.s_suppkey % 6 WHEN 3 THEN ' - Deal Data' ELSE '' END AS sheet,
  CAST(row_number() OVER (PARTITION BY n.n_nationkey ORDER BY s.s_suppkey) - 1 AS INT) AS sheet_idx, CASE WHEN s.s_suppkey % 5 = 0 THEN 'hidden' ELSE 'visible' END AS sheet_state,
  DATE '2015-01-31' + CAST(s.s_suppkey % 1000 AS INT) AS day
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
"""
#: Cells of a sheet by its number: row, column, kind and value.
SHAPES_CELLS = (
    (1, 2, "s", "CASE k % 3 WHEN 0 THEN 'Alpha ' || CAST(k % 4 AS VARCHAR(20)) || ' Capital Track Record' WHEN 1 THEN 'House ' || CAST(k % 4 AS VARCHAR(20)) END"),
    (2, 2, "s", "CASE k % 4 WHEN 0 THEN 'As of ' || substr(CAST(day AS VARCHAR(20)), 9, 2) || '/' || substr(CAST(day AS VARCHAR(20)), 6, 2) || '/' || substr(CAST(day AS VARCHAR(20)), 1, 4) WHEN 1 THEN 'Report date' WHEN 2 THEN 'Valuation date' END"),
    (2, 3, "d", "CASE WHEN k % 4 = 1 THEN CAST(day AS VARCHAR(20)) END"),
    (3, 2, "s", "CASE WHEN k % 4 = 2 THEN 'Q' || CAST(k % 3 + 1 AS VARCHAR(20)) || ' 2021' END"),
    (4, 2, "d", "CASE WHEN k % 7 = 1 THEN CAST(day AS VARCHAR(20)) END"),
    (5, 3, "s", "CASE k % 5 WHEN 1 THEN 'USD in millions' WHEN 2 THEN 'EUR in thousands' WHEN 3 THEN '($000)' WHEN 4 THEN 'GBP mm' END"),
)


def shaped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-E2."""
    d = spark.sql(SHAPES_SQL, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation")})
    cells = ", ".join(f"named_struct('row_no', {r}, 'col_no', {k}, 'vtype', '{t}', 'value', {v})" for r, k, t, v in (*SHAPES_CELLS, (9, 2, "s", "'.'")))
    return d.selectExpr("file_id", "file_name", "sheet", "sheet_idx", "sheet_state", f"inline(array({cells}))").where("value IS NOT NULL")
