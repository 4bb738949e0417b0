"""Registered queries for scalars, validation, the publish gate, and snapshots (F, V, P, A, X, S, U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import deals as D
from ..operators import discover as B
from ..operators import snapshots as A
from ..operators import standard as N
from ..operators import validate as V
from ..sources.fixtures import INPUT_END, INPUT_HEADERS, INPUT_META, INPUT_SQL, SNAPSHOT_DATES, deals_raw, deals_sql, deals_text, input_cells, text_sql
from ..sources.shared import saved
from ..streaming.ingest import ingest
from . import sql as Q
from .inputs import built, folder

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def _blank_sql(x: str, blanks) -> str:
    return f"trim({x}) IN ({', '.join(repr(b) for b in blanks)})"


def date_sql(x: str) -> str:
    tries = ", ".join(f"try_strptime(trim({x}), '{f}')" for f in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S"))
    return f"CASE WHEN NOT {_blank_sql(x, S.DATE_BLANKS)} THEN coalesce({tries})::DATE END"


def number_sql(x: str) -> str:
    return f"CASE WHEN NOT {_blank_sql(x, S.NUMBER_BLANKS)} THEN try_cast(regexp_replace(regexp_replace(trim({x}), '[,%]', '', 'g'), 'x+$', '') AS DOUBLE) END"


# ---- scalars over messy text
QUERIES["F1_F5_parsed"] = lambda spark, sf: deals_text(spark, sf).select(
    "deal_id", S.normalise_status(c("status")).alias("status"), S.to_date(c("entry_date")).alias("entry_date"), S.to_date(c("exit_date")).alias("exit_date"), S.to_number(c("total_ic")).alias("total_ic"),
    S.to_number(c("gross_tvpi")).alias("gross_tvpi"), S.to_number(c("gross_irr")).alias("gross_irr"), F.round(S.hold_period(S.to_date(c("entry_date")), S.to_date(c("exit_date"))), 6).alias("hold"),
)
ORACLE_SQL["F1_F5_parsed"] = f"""WITH t AS ({text_sql()}), p AS (SELECT deal_id, {Q._STATUS} AS status, {date_sql('entry_date')} AS entry_date, {date_sql('exit_date')} AS exit_date,
  {number_sql('total_ic')} AS total_ic, {number_sql('gross_tvpi')} AS gross_tvpi, {number_sql('gross_irr')} AS gross_irr FROM t) SELECT *, round((exit_date - entry_date) / 365.0::DOUBLE, 6) AS hold FROM p"""
_B = (("hold", "holding_period"), ("ic", "total_ic"), ("moic", "gross_tvpi"), ("ebitda", "entry_ebitda"), ("revenue", "entry_rev"), ("entry_ev", "entry_ev"), ("irr", "gross_irr"))
QUERIES["F6_F14_buckets"] = lambda spark, sf: deals_raw(spark, sf).select("deal_id", *(S.bucket(c(x), k).alias(f"{k}_bucket") for k, x in _B))
ORACLE_SQL["F6_F14_buckets"] = f"WITH {Q.DEAL_LIST} SELECT deal_id, {', '.join(f'{Q.bucket_sql(x, k)} AS {k}_bucket' for k, x in _B)} FROM raw"
QUERIES["F17_F27_labels"] = lambda spark, sf: deals_text(spark, sf).select(
    "deal_id", S.currency_guard(c("fund_currency")).alias("currency"), S.coi_flag(c("coi")).alias("coi"), S.valuation_method(c("valuation_method")).alias("method"),
    S.unique_id(c("company"), c("fund")).alias("key"), S.label(c("company")).alias("label"), S.clean_header(F.concat(c("fund"), F.lit(" \n "), c("company"))).alias("header"),
    S.column_name(F.concat(c("fund"), F.lit(" (a)(12)\n x"))).alias("column"), S.is_blank(c("total_ic")).alias("blank"), S.is_number(c("total_ic")).alias("number"),
)
ORACLE_SQL["F17_F27_labels"] = f"""WITH t AS ({text_sql()}) SELECT deal_id, CASE WHEN try_cast(replace(trim(fund_currency), ',', '') AS DOUBLE) IS NULL AND length(trim(fund_currency)) <= 12 AND trim(fund_currency) <> '' THEN trim(fund_currency) END AS currency,
  CASE WHEN coi IS NULL THEN 'n/a' WHEN lower(trim(coi)) IN ('yes', 'y', 'true', '1') THEN 'Yes' ELSE 'No' END AS coi, CASE WHEN valuation_method NOT IN ('-', 'None', 'none') THEN valuation_method END AS method,
  company || '-' || fund AS key, CASE WHEN lower(trim(company)) NOT IN ('', 'none', 'nan', 'nat', '-') THEN trim(company) END AS label,
  trim(regexp_replace(fund || ' ' || company, '\\s+', ' ', 'g')) AS header, lower(fund || ' x') AS "column", coalesce({_blank_sql('total_ic', S.ROW_BLANKS)}, true) AS blank,
  coalesce(trim(total_ic) NOT IN ('', '-', 'n/a', 'N/A', '#N/A') AND try_cast(regexp_replace(trim(total_ic), '[,%x€$]', '', 'g') AS DOUBLE) IS NOT NULL, false) AS number FROM t"""
ORACLE_SQL["F17_F27_labels"] = ORACLE_SQL["F17_F27_labels"].replace("lower(fund || ' x')", "coalesce(lower(fund || ' x'), '')")


# ---- validation
def checked(spark, sf):
    d = deals_raw(spark, sf)
    return d.select("deal_id", "gp_name", "company", "fund", "entry_date", "exit_date", c("gross_tvpi").alias("gross_moic"), "gross_irr", "ic_initial", c("total_ic").alias("ic_total"), "realized", c("current_value").alias("unrealized"), (c("realized") + c("current_value")).alias("total_value"), "holding_period", "fund_ownership")


_CHECKED = f"WITH {Q.DEAL_LIST}, v AS (SELECT *, gross_tvpi AS moic, total_ic AS ict, realized + current_value AS tv FROM raw)"
_RULES = (
    ("gross_moic", "error", "MOIC must be positive", "moic <= 0"), ("gross_moic", "warning", "MOIC > 100x is highly unusual", "moic >= 100"), ("gross_irr", "warning", "IRR outside plausible range", "gross_irr <= -1 OR gross_irr >= 20"),
    ("ic_initial", "error", "Invested capital cannot be negative", "ic_initial < 0"), ("ic_total", "error", "Invested capital cannot be negative", "ict < 0"), ("realized", "warning", "Realized value should be non-negative", "realized < 0"),
    ("unrealized", "warning", "Unrealized value should be non-negative", "current_value < 0"), ("total_value", "warning", "Total value should be non-negative", "tv < 0"), ("holding_period", "warning", "Hold period outside 0-40 years", "holding_period <= 0 OR holding_period >= 40"),
    ("fund_ownership", "warning", "Ownership percentage should be 0-100", "fund_ownership <= 0 OR fund_ownership > 100"), ("entry_date / exit_date", "error", "Exit date precedes entry date", "entry_date > exit_date"),
    ("ic_total / realized", "warning", "Realized value is > 200x invested capital", "ict > 0.5 AND realized > 200 * ict"),
)
_ISSUES = " UNION ALL ".join(f"SELECT deal_id, '{s}' AS severity, '{f}' AS field_id, '{m}' AS message FROM v WHERE {w}" for f, s, m, w in _RULES)
QUERIES["V1_V12_issues"] = lambda spark, sf: V.issues(checked(spark, sf)).drop("value", "kind")
ORACLE_SQL["V1_V12_issues"] = f"{_CHECKED} {_ISSUES}"
QUERIES["V13_V16_fill"] = lambda spark, sf: V.fill_issues(checked(spark, sf))
ORACLE_SQL["V13_V16_fill"] = f"{_CHECKED} SELECT gp_name, 'gross_moic' AS field_id, 'thinly filled' AS issue, round(avg((moic IS NOT NULL)::INTEGER), 6) AS fill FROM v GROUP BY gp_name HAVING avg((moic IS NOT NULL)::INTEGER) < 0.5"
QUERIES["V17_irr_unit"] = lambda spark, sf: V.irr_unit_issues(checked(spark, sf).withColumn("gross_irr", F.when(c("gp_name") != "GP_ASIA", c("gross_irr") * 100).otherwise(c("gross_irr"))))
ORACLE_SQL["V17_irr_unit"] = f"{_CHECKED} SELECT gp_name, count(i) AS n, round(avg((abs(i) > 3)::INTEGER), 6) AS large FROM (SELECT gp_name, (CASE WHEN gp_name <> 'GP_ASIA' THEN gross_irr * 100 ELSE gross_irr END)::DOUBLE AS i FROM v) WHERE i IS NOT NULL GROUP BY gp_name HAVING count(i) >= 3 AND avg((abs(i) > 3)::INTEGER) > 0.5"
QUERIES["V18_severity_counts"] = lambda spark, sf: V.severity_counts(V.issues(checked(spark, sf)))
ORACLE_SQL["V18_severity_counts"] = f"{_CHECKED} SELECT severity, field_id, message, count(*) AS issues FROM ({_ISSUES}) GROUP BY ALL"
QUERIES["V18_labels"] = lambda spark, sf: V.issue_labels(V.issues(checked(spark, sf)))
ORACLE_SQL["V18_labels"] = f"{_CHECKED} SELECT deal_id, '[' || upper(severity) || '] ' || field_id || ' @ row ' || deal_id || ': ' || message AS label FROM ({_ISSUES})"
QUERIES["U1_own_rule"] = lambda spark, sf: V.issues(checked(spark, sf), [V.Rule("fund_ownership", c("fund_ownership") < 90, "warning", "close to full ownership")]).drop("value", "kind")
ORACLE_SQL["U1_own_rule"] = f"{_CHECKED} SELECT deal_id, 'warning' AS severity, 'fund_ownership' AS field_id, 'close to full ownership' AS message FROM v WHERE fund_ownership >= 90"

# ---- publish gate: a file for each manager; one lacks its name, one its date, one its currency
_META = "SELECT file, CASE WHEN file <> 'GP_AFRICA' THEN file END AS gp_name, CASE WHEN file <> 'GP_AMERICA' THEN DATE '2001-12-31' END AS as_of, CASE WHEN file <> 'GP_ASIA' THEN 'USD' END AS currency FROM (SELECT DISTINCT file FROM {t}) q"
QUERIES["P1_P7_gate"] = lambda spark, sf: V.gate(deals_text(spark, sf), spark.sql(_META, t=deals_text(spark, sf))).drop("first_bad_numbers", "first_bad_dates")
_BAD = " UNION ALL ".join(f"SELECT file, row_no, '{k}' AS kind, {i} AS i, '{x} row ' || row_no AS cell FROM t WHERE {bad(x)} = 1" for k, cols, bad in (("n", V.NUMERIC, lambda x: f"(trim(coalesce({x}, '')) <> '' AND try_cast({x} AS DOUBLE) IS NULL)::INTEGER"), ("d", V.DATES, lambda x: f"(trim(coalesce({x}, '')) <> '' AND {date_sql(x)} IS NULL)::INTEGER")) for i, x in enumerate(cols))
ORACLE_SQL["P3_P4_first_bad"] = f"""WITH t AS ({text_sql()}), bad AS ({_BAD}), k AS (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY row_no, i) AS k FROM bad), g AS (SELECT file, kind, string_agg(cell, '; ' ORDER BY row_no, i) AS cells FROM k WHERE k <= 8 GROUP BY file, kind)
  SELECT f.file, coalesce(n.cells, '') AS first_bad_numbers, coalesce(x.cells, '') AS first_bad_dates FROM (SELECT DISTINCT file FROM t) f LEFT JOIN g n ON n.file = f.file AND n.kind = 'n' LEFT JOIN g x ON x.file = f.file AND x.kind = 'd'"""
_n = lambda x: f"(trim(coalesce({x}, '')) <> '' AND try_cast({x} AS DOUBLE) IS NULL)::INTEGER"
_d = lambda x: f"(trim(coalesce({x}, '')) <> '' AND {date_sql(x)} IS NULL)::INTEGER"
ORACLE_SQL["P1_P7_gate"] = f"""WITH t AS ({text_sql()}), m AS ({_META.format(t='t')}), r AS (SELECT file, count(*) AS rows, count(*) FILTER (trim(coalesce(company, '')) = '') AS blank_company,
  sum({' + '.join(_n(x) for x in V.NUMERIC)}) AS bad_numbers, sum({' + '.join(_d(x) for x in V.DATES)}) AS bad_dates, count(*) FILTER (trim(coalesce(fund, '')) = '') AS blank_fund,
  count(*) FILTER (trim(coalesce(status, '')) <> '' AND lower(trim(status)) NOT IN ('realized', 'unrealized')) AS other_status, count(*) FILTER (try_cast(gross_tvpi AS DOUBLE) < 0) AS negative_tvpi,
  count(*) FILTER (abs(try_cast(gross_irr AS DOUBLE)) > 3) AS large_irr, count(*) FILTER (trim(coalesce(total_ic, '')) = '' OR try_cast(total_ic AS DOUBLE) = 0) AS no_ic FROM t GROUP BY file)
  SELECT m.*, r.* EXCLUDE file, CASE WHEN m.gp_name IS NULL OR as_of IS NULL OR blank_company + bad_numbers + bad_dates > 0 THEN 1 WHEN currency IS NULL OR blank_fund + other_status + negative_tvpi + large_irr + no_ic > 0 THEN 2 ELSE 0 END AS decision FROM m LEFT JOIN r USING (file)"""
QUERIES["P3_P4_first_bad"] = lambda spark, sf: V.gate(deals_text(spark, sf), spark.sql(_META, t=deals_text(spark, sf))).select("file", "first_bad_numbers", "first_bad_dates")
QUERIES["P5_duplicates"] = lambda spark, sf: V.duplicates(deals_text(spark, sf).withColumn("company", F.when(c("row_no") % 2 == 0, F.upper("company")).otherwise(c("company"))))
ORACLE_SQL["P5_duplicates"] = f"WITH t AS (SELECT * REPLACE (CASE WHEN row_no % 2 = 0 THEN upper(company) ELSE company END AS company) FROM ({text_sql()})), d AS (SELECT *, min(row_no) OVER (PARTITION BY file, lower(trim(company)), lower(trim(fund))) AS first_row FROM t WHERE trim(company) <> '' AND trim(fund) <> '') SELECT file, row_no, company, fund, first_row FROM d WHERE row_no > first_row"


# ---- snapshots
def publish_all(spark, sf, where: str):
    """F-G: the deals are computed once and stored by manager; three dates in one publication, then a correction of one key.

    Only what is known of a deal is published: columns derived from that are derived by the readers.
    """
    staged = folder(spark, "deals")
    d = deals_raw(spark, sf).withColumn("fund_currency", S.currency_guard(c("fund_currency")))
    d.hint("rebalance", "gp_name").write.partitionBy("gp_name").option("compression", "zstd").parquet(staged)
    d = spark.read.schema(d.schema).parquet(staged).select(*d.columns)
    parts = []
    for i, day in enumerate(SNAPSHOT_DATES):
        rows = d.where(c("entry_date") <= F.lit(day).cast("date"))
        rows = rows.where("gp_name <> 'GP_EUROPE'") if i == 2 else rows
        parts.append(A.long_table(rows, day, "team", f"2002-01-0{i + 1} 00:00:00", "orders", "USD"))
    A.publish(reduce(DataFrame.union, parts), where, gathered=True)
    again = d.where((c("entry_date") <= F.lit(SNAPSHOT_DATES[1]).cast("date")) & (c("gp_name") == "GP_ASIA") & c("fund").isNotNull())
    A.publish(A.long_table(again, SNAPSHOT_DATES[1], "desk", "2002-02-01 00:00:00", "orders", "USD"), where, gathered=True)


def _derived(rows):
    return rows.transform(D.returns).transform(D.operating)


def published(spark, sf):
    """F-G written and read again, from a store, with the derived columns."""
    return _derived(_store(spark, sf).read())


_SNAP = Q.over_deals("").rstrip() + ", snaps AS (" + " UNION ALL ".join(
    f"SELECT *, DATE '{day}' AS track_record_date, '{'team'}' AS published_by, TIMESTAMP '2002-01-0{i + 1} 00:00:00' AS published_at FROM deals WHERE entry_date <= DATE '{day}'" + (" AND gp_name <> 'GP_EUROPE'" if i == 2 else "") + (" AND gp_name <> 'GP_ASIA'" if i == 1 else "") for i, day in enumerate(SNAPSHOT_DATES)
) + f" UNION ALL SELECT *, DATE '{SNAPSHOT_DATES[1]}', 'desk', TIMESTAMP '2002-02-01 00:00:00' FROM deals WHERE entry_date <= DATE '{SNAPSHOT_DATES[1]}' AND gp_name = 'GP_ASIA' AND fund IS NOT NULL), newest AS (SELECT * FROM snaps QUALIFY track_record_date = max(track_record_date) OVER (PARTITION BY gp_name))"


def _store(spark, sf):
    return A.SnapshotStore(spark, built(spark, sf, "snapshots", lambda where: publish_all(spark, sf, where)))


def _snap(name, run, sql, latest=True):
    QUERIES[name] = lambda spark, sf: run(_derived(_store(spark, sf).latest()) if latest else published(spark, sf))
    ORACLE_SQL[name] = f"{_SNAP} {sql}"


QUERIES["A6_A7_inventory"] = lambda spark, sf: _store(spark, sf).inventory()
ORACLE_SQL["A6_A7_inventory"] = f"{_SNAP} SELECT gp_name, track_record_date, count(*) AS deals, arg_max(published_by, published_at) AS published_by, max(published_at) AS published_at FROM snaps GROUP BY 1, 2"
_snap("A4_A8_long_table", lambda s: s.select("deal_id", "gp_name", "track_record_date", "fund_currency", "gp_key", c("as_of").cast("string").alias("as_of")), "SELECT deal_id, gp_name, track_record_date, coalesce(fund_currency, 'USD') AS fund_currency, gp_name AS gp_key, track_record_date::VARCHAR AS as_of FROM snaps", latest=False)
_snap("X1_latest", lambda s: s.select("deal_id", "gp_name", "track_record_date"), "SELECT deal_id, gp_name, track_record_date FROM newest")
_snap("X2_over_time", A.over_time, f"SELECT * EXCLUDE impaired_ratio, round(moic - lag(moic) OVER (PARTITION BY gp_name ORDER BY track_record_date), 6) AS moic_change FROM (SELECT gp_name, track_record_date, {Q.POOLED} FROM snaps GROUP BY 1, 2)", latest=False)
_snap("X3_overview", A.overview, f"SELECT count(DISTINCT gp_name) AS gps, count(*) AS deals, round({Q._div('sum(coalesce(total_value, 0))', 'sum(ic_weight)')}, 6) AS moic, round(median(hold_period), 6) AS median_hold FROM newest")
_snap("X4_X7_by_gp", A.by_gp, f"SELECT gp_name, {Q.POOLED}, round({Q._div('sum(realized)', 'sum(ic_weight)')}, 6) AS dpi FROM newest GROUP BY 1".replace(f", round({Q._div('sum(impaired_value)', 'sum(ic_weight)')}, 6) AS impaired_ratio", ""))
ORACLE_SQL["X4_X7_by_gp"] = f"SELECT * EXCLUDE impaired_ratio FROM ({ORACLE_SQL['X4_X7_by_gp']})" if "impaired_ratio" in ORACLE_SQL["X4_X7_by_gp"].rsplit("FROM newest")[0].rsplit("SELECT gp_name", 1)[-1] else ORACLE_SQL["X4_X7_by_gp"]
_snap("X5_scatter", A.scatter, "SELECT deal_id, status, round(gross_moic, 6) AS moic, round(hold_period, 6) AS hold FROM newest WHERE gross_moic IS NOT NULL AND hold_period IS NOT NULL")
_snap("X6_browser", lambda s: s.where("gp_name = 'GP_ASIA' AND status = 'Realized' AND fund = 'ASIA Fund BUILDING'").select("deal_id", "fund", "sector", "geography"), "SELECT deal_id, fund, sector, geography FROM newest WHERE gp_name = 'GP_ASIA' AND status = 'Realized' AND fund = 'ASIA Fund BUILDING'")
_snap("X7_deployment", A.deployment, "SELECT gp_name, vintage, sum(ic_weight)::DECIMAL(24,7) AS ic, count(*) AS deals FROM newest GROUP BY 1, 2")


# ---- from grids to snapshots: meta block and rows of each file, the gate, and one publication of what passes
def _flow(spark, sf):
    cells = spark.read.parquet(built(spark, sf, "input_cells", input_cells(spark, sf).write.parquet))
    rows = saved(N.input_rows(B.input_grid(cells), INPUT_HEADERS))
    judged = saved(V.gate(rows, B.input_meta(cells).withColumnRenamed("file_id", "file")))
    lacking = B.header_differences(B.input_headers(cells), list(INPUT_HEADERS.values())).where(F.size("missing") > 0)
    passed = judged.where("decision <> 1").join(lacking, c("file") == c("file_id"), "left_anti")
    deals_ = rows.join(passed.select("file", "gp_name", "as_of", "currency"), "file").withColumns({"total_ic": c("total_ic").cast("decimal(24,7)"), "fund_currency": F.lit(None).cast("string")})
    stamped = A.long_table(deals_, None, "team", "2002-01-05 00:00:00").withColumns({"track_record_date": c("as_of"), "source_file": c("file"), "fund_currency": c("currency")}).drop("as_of", "currency")
    store = A.SnapshotStore(spark, folder(spark, "gated"))
    store.publish(stamped)
    total = store.read().groupBy("gp_name").agg(F.sum("total_ic").cast("decimal(24,7)").alias("ic"))
    out = judged.join(store.inventory().select("gp_name", "track_record_date", "deals", "published_by"), "gp_name", "left").join(total, "gp_name", "left")
    return out.select("file", "as_of", "currency", "rows", "bad_numbers", "first_bad_numbers", "decision", "track_record_date", "deals", "published_by", "ic")


QUERIES["A2_A7_grid_to_snapshot"] = _flow
_T = f"t AS (SELECT * FROM ({INPUT_SQL.format(deals=f'({deals_sql()})')}) WHERE NOT (file = '{INPUT_END[0]}' AND row_no > {INPUT_END[1]}))"
ORACLE_SQL["A2_A7_grid_to_snapshot"] = f"""WITH {_T}, m AS ({INPUT_META.format(t='t')}), r AS (SELECT file, count(*) AS rows, count(*) FILTER (trim(coalesce(company, '')) = '') AS blank_company,
  sum({' + '.join(_n(x) for x in V.NUMERIC)}) AS bad_numbers, string_agg(CASE WHEN {_n('total_ic')} = 1 AND k <= 8 THEN 'total_ic row ' || (row_no + 7) END, '; ' ORDER BY row_no) AS first_bad_numbers, sum({' + '.join(_d(x) for x in V.DATES)}) AS bad_dates,
  count(*) FILTER (trim(coalesce(fund, '')) = '') AS blank_fund, count(*) FILTER (try_cast(gross_tvpi AS DOUBLE) < 0) AS negative_tvpi, count(*) FILTER (abs(try_cast(gross_irr AS DOUBLE)) > 3) AS large_irr,
  count(*) FILTER (trim(coalesce(total_ic, '')) = '' OR try_cast(total_ic AS DOUBLE) = 0) AS no_ic, sum(try_cast(total_ic AS DECIMAL(24,7)))::DECIMAL(24,7) AS ic FROM (SELECT *, sum({_n('total_ic')}) OVER (PARTITION BY file ORDER BY row_no) AS k FROM t) GROUP BY file),
  j AS (SELECT m.*, r.* EXCLUDE file, CASE WHEN gp_name IS NULL OR as_of IS NULL OR blank_company + bad_numbers + bad_dates > 0 THEN 1 WHEN currency IS NULL OR blank_fund + negative_tvpi + large_irr + no_ic > 0 THEN 2 ELSE 0 END AS decision FROM m JOIN r USING (file))
  SELECT file, as_of, currency, rows, bad_numbers, coalesce(first_bad_numbers, '') AS first_bad_numbers, decision, CASE WHEN decision <> 1 THEN as_of END AS track_record_date, CASE WHEN decision <> 1 THEN rows END AS deals, CASE WHEN decision <> 1 THEN 'team' END AS published_by, CASE WHEN decision <> 1 THEN ic END AS ic FROM j"""


def _stream(spark, sf):
    """Two arrivals of files of all managers, the second one with a correction of one; then each file again."""
    incoming, target, state = (folder(spark, x) for x in ("incoming", "snapshots", "state"))
    d = deals_raw(spark, sf).select("deal_id", "gp_name", "fund_currency", "total_ic")
    rows = [A.long_table(d.where(which), SNAPSHOT_DATES[0], "team", f"2002-0{m}-01 00:00:00", "orders", "USD") for which, m in (("true", 1), ("gp_name = 'GP_ASIA'", 3))]
    for r in rows:
        r.write.mode("append").parquet(incoming)
        ingest(spark, incoming, target, state, r.schema).awaitTermination()
    ingest(spark, incoming, target, folder(spark, "state"), rows[0].schema).awaitTermination()
    return A.read_snapshots(spark, target).select("deal_id", "gp_name", "track_record_date", "published_at")


QUERIES["S1_incremental_ingest"] = _stream
ORACLE_SQL["S1_incremental_ingest"] = Q.over_deals("SELECT deal_id, gp_name, DATE '1997-12-31' AS track_record_date, CASE WHEN gp_name = 'GP_ASIA' THEN TIMESTAMP '2002-03-01 00:00:00' ELSE TIMESTAMP '2002-01-01 00:00:00' END AS published_at FROM raw")
