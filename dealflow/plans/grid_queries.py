"""Registered queries for cleaning, profiles, scales, matching and discovery (E, C, G, D, B, A families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.catalog import DEAL_KEYWORDS, SHEET_KEYWORDS, SKIP_SHEETS
from ..functions.scalars import ROW_BLANKS
from ..operators import clean as E
from ..operators import discover as B
from ..operators import matching as M
from ..operators import profile as P
from ..operators import standard as N
from ..sources import fixtures as X
from ..sources.shared import saved
from . import sql as Q
from .inputs import built, built_table, folder
from .match_sql import TWINS

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def _cells(spark, sf):
    """The landed grid as a table, written once a session and input: the operators read it several times."""
    return spark.read.parquet(built(spark, sf, "cells", X.landed_cells(spark, sf).write.parquet))


def _rows(spark, sf):
    """The row summaries of the landed grid, written once."""
    return built_table(spark, sf, "rows", lambda: B.rows_of(_cells(spark, sf)))


FIN = ["total_ic", "realized"]

# ---- cleaning
_BL = ", ".join(repr(b) for b in ROW_BLANKS)
_blank = lambda x: f"({x} IS NULL OR trim({x}) IN ({_BL}))"
_num = lambda x: f"coalesce(trim({x}) NOT IN ('', '-', 'n/a', 'N/A', '#N/A') AND try_cast(regexp_replace(trim({x}), '[,%x€$]', '', 'g') AS DOUBLE) IS NOT NULL, false)"
_match = lambda x, *patterns: "(" + " OR ".join(f"regexp_matches(trim(coalesce({x}, '')), '{p}')" for p in patterns) + ")"
_ann = lambda x: f"(trim(coalesce({x}, '')) <> '' AND {_match(x, E.ANNOTATION, E.TOTAL)})"
_note = lambda x: f"({_match(x, E.NOTE, E.AGGREGATE)} OR trim(coalesce({x}, '')) LIKE '(%' OR length(trim({x})) > 80 OR len(regexp_split_to_array(trim({x}), '\\s+')) > 10)"
_TAGGED = f"""r AS ({X.raw_sql()}), funds AS (SELECT DISTINCT file AS ff, trim(fund) AS fn FROM r WHERE trim(fund) <> ''),
tagged AS (SELECT r.*, CASE WHEN {_ann('fund')} OR {_ann('company')} THEN 'annotation' WHEN fn IS NOT NULL AND {_blank('entry_date')} THEN 'fund_name'
  WHEN trim(coalesce(company, '')) <> '' AND (length(trim(company)) > 60 OR trim(company) LIKE '%:' OR len(regexp_split_to_array(trim(company), '\\s+')) >= 10) AND {_blank('entry_date')} AND NOT ({_num('total_ic')} OR {_num('realized')}) THEN 'sentence'
  WHEN {_blank('company')} AND {_blank('entry_date')} AND NOT ({_num('total_ic')} OR {_num('realized')}) THEN 'empty' END AS rule FROM r LEFT JOIN funds ON file = ff AND trim(company) = fn)"""
QUERIES["E7_E11_drop_report"] = lambda spark, sf: E.drop_report(X.raw_rows(spark, sf), FIN)
ORACLE_SQL["E7_E11_drop_report"] = f"WITH {_TAGGED} SELECT file, rule, count(*) AS dropped FROM tagged WHERE rule IS NOT NULL GROUP BY 1, 2"
QUERIES["E1_E10_deal_rows"] = lambda spark, sf: E.deal_rows(X.raw_rows(spark, sf), FIN)
ORACLE_SQL["E1_E10_deal_rows"] = f"WITH {_TAGGED} SELECT * EXCLUDE (rule) FROM tagged WHERE rule IS NULL"
QUERIES["E4_fund_sections"] = lambda spark, sf: E.inherit_sections(X.raw_rows(spark, sf), X.RAW_VALUES)
ORACLE_SQL["E4_fund_sections"] = f"""WITH r AS ({X.raw_sql()}), b AS (SELECT *, NOT {_blank('company')} AND {' AND '.join(map(_blank, X.RAW_VALUES))} AND NOT {_ann('company')} AND NOT {_note('company')} AS banner, avg((NOT {_blank('fund')})::INTEGER) OVER (PARTITION BY file) AS filled FROM r),
  s AS (SELECT *, last_value(CASE WHEN banner THEN regexp_replace(trim(company), '{E.VINTAGE_TAIL}', '') END IGNORE NULLS) OVER (PARTITION BY file, tab ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS section FROM b),
  u AS (SELECT *, filled <= 0.5 AND max((section IS NOT NULL AND NOT banner)::INTEGER) OVER (PARTITION BY file) = 1 AS inherits FROM s)
  SELECT * EXCLUDE (banner, filled, section, inherits) REPLACE (CASE WHEN inherits THEN coalesce(section, tab) ELSE fund END AS fund) FROM u WHERE NOT (inherits AND banner)"""
QUERIES["E5_fund_from_tab"] = lambda spark, sf: E.fund_from_tab(X.raw_rows(spark, sf)).groupBy("file", "fund").agg(F.count("*").alias("rows"))
ORACLE_SQL["E5_fund_from_tab"] = f"WITH r AS ({X.raw_sql()}), m AS (SELECT *, avg((fund IS NULL)::INTEGER) OVER (PARTITION BY file) AS missing FROM r) SELECT file, CASE WHEN missing > 0.5 THEN tab ELSE fund END AS fund, count(*) AS rows FROM m GROUP BY 1, 2"
QUERIES["E6_keep_first"] = lambda spark, sf: E.keep_first(X.raw_rows(spark, sf))
ORACLE_SQL["E6_keep_first"] = f"WITH r AS ({X.raw_sql()}) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY file, company, fund, entry_date ORDER BY row_no, tab DESC) = 1"
QUERIES["E12_excluded"] = lambda spark, sf: E.excluded(X.deals_raw(spark, sf), c("total_ic") < 0).groupBy("excluded").agg(F.count("*").alias("deals"))
ORACLE_SQL["E12_excluded"] = Q.over_deals("SELECT coalesce(total_ic < 0, false) AS excluded, count(*) AS deals FROM raw GROUP BY 1")


# ---- profiles and scales
def text_cells(spark, sf):
    cols = ["company", "fund", "entry_date", "total_ic", "realized", "gross_tvpi", "gross_irr", "status", "coi"]
    d = saved(X.deals_text(spark, sf).select("file", "row_no", *cols))
    cell = lambda i, x: F.struct(F.lit(i).alias("col_index"), F.lit(x).alias("col_name"), c(x).alias("value"))
    return d.select("file", "row_no", F.inline(F.array(*(cell(i, x) for i, x in enumerate(cols)))))


QUERIES["C4_C5_profiles"] = lambda spark, sf: P.column_profiles(text_cells(spark, sf)).select("file", "col_name", "data_type", F.round("fill_rate", 6).alias("fill_rate"), "distinct", F.round("value_min", 4).alias("value_min"), F.round("value_max", 4).alias("value_max"), F.round("value_mean", 4).alias("value_mean"), F.array_join("samples", "; ").alias("samples"), "unit", "looks_moic", "looks_irr", "looks_currency", "looks_date", "looks_identifier")
_PB = ", ".join(repr(b) for b in P.PROFILE_BLANKS)
_sh = lambda cond: f"avg(({cond})::INTEGER) FILTER (num IS NOT NULL)"
ORACLE_SQL["C4_C5_profiles"] = f"""WITH t AS ({X.text_sql()}), l AS (SELECT file, row_no, unnest(['company', 'fund', 'entry_date', 'total_ic', 'realized', 'gross_tvpi', 'gross_irr', 'status', 'coi']) AS col_name, unnest([company, fund, entry_date, total_ic, realized, gross_tvpi, gross_irr, status, coi]) AS value FROM t),
  v AS (SELECT file, col_name, row_no, CASE WHEN trim(value) NOT IN ({_PB}) THEN trim(value) END AS v FROM l), n AS (SELECT *, try_cast(v AS DOUBLE) AS num, regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')::INTEGER AS d, row_number() OVER (PARTITION BY file, col_name, v IS NULL ORDER BY row_no) AS place FROM v),
  g AS (SELECT file, col_name, count(*) AS rows, count(v) AS n, avg(d) AS dates, count(num) AS nums, min(num) AS lo, max(num) AS hi, avg(num) AS mean, count(DISTINCT v) AS "distinct", avg(length(v)) AS len, {_sh('abs(num) <= 2')} AS small, avg(contains(v, '%')::INTEGER) AS pct,
    {_sh('num > 0 AND num < 30')} AS m1, {_sh('num >= 0.5 AND num <= 15')} AS m2, {_sh('num > -0.9 AND num < 3')} AS i1, {_sh('num > -90 AND num < 300')} AS i2, {_sh('num >= 0.1')} AS c1, string_agg(v, '; ' ORDER BY row_no) FILTER (v IS NOT NULL AND place <= 10) AS samples FROM n GROUP BY 1, 2),
  k AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN dates >= 0.5 THEN 'date' WHEN nums / n >= 0.75 AND (small >= 0.8 OR pct >= 0.3) THEN 'percent' WHEN nums / n >= 0.75 THEN 'numeric' WHEN nums / n >= 0.3 THEN 'mixed' ELSE 'string' END AS data_type FROM g)
  SELECT file, col_name, data_type, round(n / rows, 6) AS fill_rate, "distinct", round(CASE WHEN nums >= 3 THEN lo END, 4) AS value_min, round(CASE WHEN nums >= 3 THEN hi END, 4) AS value_max, round(CASE WHEN nums >= 3 THEN mean END, 4) AS value_mean, samples, NULL::VARCHAR AS unit,
  coalesce(nums >= 3 AND m1 >= 0.85 AND m2 >= 0.6 AND mean > 0.5 AND mean < 20, false) AS looks_moic, coalesce(nums >= 3 AND ((i1 >= 0.9 AND data_type IN ('numeric', 'mixed') AND mean < 0.5) OR (i2 >= 0.9 AND data_type = 'percent')), false) AS looks_irr,
  coalesce(nums >= 3 AND c1 >= 0.8 AND hi >= 1, false) AS looks_currency, coalesce(dates >= 0.5, false) AS looks_date, coalesce(data_type = 'string' AND n / rows >= 0.5 AND "distinct" >= least(3.0, n * 0.3) AND len < 60, false) AS looks_identifier FROM k"""
_SCALE = "CASE gp_name WHEN 'GP_AFRICA' THEN 1 WHEN 'GP_AMERICA' THEN 1000 WHEN 'GP_ASIA' THEN 1000 WHEN 'GP_EUROPE' THEN 1000000 ELSE 1 END"
_FIELDS = (("ic_total", "total_ic"), ("realized", "realized"), ("unrealized", "current_value"), ("entry_rev", "entry_rev"), ("entry_ebitda", "entry_ebitda"))


def _scales(spark, sf):
    d = X.deals_raw(spark, sf)
    cell = lambda f, x: F.struct(F.lit(f).alias("field_id"), (c(x).cast("double") * F.expr(_SCALE)).alias("value"))
    values = d.select(c("gp_name").alias("file"), F.inline(F.array(*(cell(f, x) for f, x in _FIELDS))))
    heads = values.select("file", "field_id").distinct().withColumn("col_name", F.when(c("file") == "GP_AMERICA", F.concat("field_id", F.lit(" ('000)"))).otherwise(c("field_id")))
    banners = values.select("file").distinct().withColumn("banner", F.when(c("file") == "GP_ASIA", "k"))
    return P.monetary_scale(values, heads, banners)


QUERIES["G1_monetary_scale"] = _scales
_UNION = " UNION ALL ".join(f"SELECT gp_name AS file, '{f}' AS field_id, abs({x}::DOUBLE * {_SCALE}) AS a FROM raw" for f, x in _FIELDS)
_G1 = f"""med AS (SELECT file, field_id, median(a) AS m FROM ({_UNION}) WHERE a > 0 GROUP BY 1, 2), reg AS (SELECT *, max(m) OVER (PARTITION BY file) AS top FROM med),
  fac AS (SELECT file, field_id, CASE WHEN file = 'GP_AMERICA' AND m >= 1e3 THEN 1e-3 WHEN file = 'GP_ASIA' AND m >= 100 AND m < 1e7 THEN 1e-3 WHEN m >= 1e6 THEN 1e-6 WHEN m >= 1e3 AND top >= 1e6 THEN 1e-6 WHEN m >= 1e3 AND top >= 5e4 THEN 1e-3 ELSE 1 END::DOUBLE AS factor FROM reg)"""
ORACLE_SQL["G1_monetary_scale"] = f"WITH {Q.DEAL_LIST}, {_G1} SELECT * FROM fac WHERE factor <> 1"
QUERIES["G2_rescale_notice"] = lambda spark, sf: P.rescale_notice(_scales(spark, sf))
ORACLE_SQL["G2_rescale_notice"] = f"WITH {Q.DEAL_LIST}, {_G1} SELECT file, CASE WHEN factor < 1e-4 THEN '1e6' ELSE '1e3' END AS divided_by, string_agg(field_id, ', ' ORDER BY field_id) AS fields FROM fac WHERE factor <> 1 GROUP BY 1, 2"
QUERIES["C1_stacked_tabs"] = lambda spark, sf: P.stacked({"F": X.deals_raw(spark, sf).where("exit_date IS NOT NULL").select("deal_id", "exit_date"), "O": X.deals_raw(spark, sf).where("exit_date IS NULL").select("deal_id", "sector")})
ORACLE_SQL["C1_stacked_tabs"] = Q.over_deals("SELECT deal_id, exit_date, CASE WHEN exit_date IS NULL THEN sector END AS sector, CASE WHEN exit_date IS NULL THEN 'O' ELSE 'F' END AS fund_tab FROM raw")


def _sheets(spark, sf):
    return _cells(spark, sf).select("file_id", "sheet").distinct()


_SHEETS = Q.over_deals("").rstrip() + ", sheets AS (SELECT DISTINCT gp_name AS file_id, fund || ' - Deal Data' AS sheet, fund FROM raw WHERE fund IS NOT NULL)"
QUERIES["C2_fund_labels"] = lambda spark, sf: P.fund_labels(_sheets(spark, sf).withColumnRenamed("file_id", "file"))
ORACLE_SQL["C2_fund_labels"] = f"{_SHEETS} SELECT file_id AS file, sheet, fund AS fund_label FROM sheets"
QUERIES["C3_units"] = lambda spark, sf: _cells(spark, sf).where("row_no = 4").groupBy("value").agg(F.first(P.unit(c("value"))).alias("unit"))
ORACLE_SQL["C3_units"] = "SELECT * FROM (VALUES " + ", ".join(f"('{h}', {repr('USD m') if '$m' in h else 'NULL'})" for _, h in X.SHEET_HEADERS) + ") t(value, unit)"


# ---- matching, over the headers and values of the landed sheets
def _columns(spark, sf):
    cells = _cells(spark, sf)
    # Written, so that Spark knows how short the list of headers is and need not shuffle the cells for it.
    names = built_table(spark, sf, "names", lambda: saved(cells.where("row_no = 4").select("file_id", "sheet", "col_no", c("value").alias("col_name"))))
    v = cells.where("row_no > 4").join(names, ["file_id", "sheet", "col_no"])
    return v.select(c("file_id").alias("file"), (c("col_no") - 2).alias("col_index"), "col_name", (c("sheet_idx") * F.lit(1 << 32) + c("row_no")).alias("row_no"), "value")


def _profiles(spark, sf):
    """The profiles of the landed sheets' columns, written once; C4_C5 times their making over the text deals."""
    return spark.read.parquet(built(spark, sf, "profiles", P.column_profiles(_columns(spark, sf)).write.parquet))


QUERIES["D1_D9_scores"] = lambda spark, sf: M.scores(_profiles(spark, sf)).select("file", "col_name", "field_id", F.round("confidence", 6).alias("confidence"), F.array_join("signals", ",").alias("signals"))
QUERIES["D10_D12_mapping"] = lambda spark, sf: M.mapping(_profiles(spark, sf)).select("file", "field_id", "col_name", F.round("confidence", 6).alias("confidence"), "status", "tier", "optional")
QUERIES["D12_unmapped_columns"] = lambda spark, sf: M.unmapped_columns(_profiles(spark, sf), M.mapping(_profiles(spark, sf)))
QUERIES["D13_review_report"] = lambda spark, sf: M.review_report(M.mapping(_profiles(spark, sf)), spark.sql("SELECT gp_name AS file, CASE WHEN total_ic < 0 THEN 'error' ELSE 'warning' END AS severity FROM {d}", d=X.deals_raw(spark, sf)))
QUERIES["D14_mapping_log"] = lambda spark, sf: M.mapping_log(M.mapping(_profiles(spark, sf)))
QUERIES["D15_rule_match"] = lambda spark, sf: M.rule_match(_profiles(spark, sf))
QUERIES["D16_value_match"] = lambda spark, sf: M.value_match(_columns(spark, sf))
QUERIES["D17_layered"] = lambda spark, sf: M.layered(_profiles(spark, sf), _columns(spark, sf))
QUERIES["D18_by_position"] = lambda spark, sf: M.by_position(_profiles(spark, sf), _profiles(spark, sf).select("file", F.lit("company").alias("field_id"), F.lit(0).alias("col_index")).distinct())
ORACLE_SQL["D18_by_position"] = f"{_SHEETS} SELECT DISTINCT file_id AS file, 'company' AS field_id, 0 AS col_index, 'Portfolio Company (a)' AS col_name FROM sheets"
QUERIES["D19_review_queue"] = lambda spark, sf: M.review_queue(M.mapping(_profiles(spark, sf)))
QUERIES["A11_slug"] = lambda spark, sf: X.deals_raw(spark, sf).select("fund", M.slug(c("fund")).alias("slug")).distinct()
ORACLE_SQL["A11_slug"] = Q.over_deals("SELECT DISTINCT fund, replace(lower(fund), ' ', '_') AS slug FROM raw")


def _semantic(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    mean = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(c("col").cast("double")).alias("m"))
    fields = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("field_vector"))
    # The labels are the fields: as many as the catalogue has at most.
    return M.semantic(e.select(c("vec_id").alias("key"), c("embedding").alias("vector")), fields.select(c("label").cast("string").alias("field_id"), "field_vector")).select("key", "field_id", F.round("confidence", 5).alias("confidence"))


QUERIES["D8_semantic"] = _semantic


def _vector_columns(spark, sf):
    """Files of 25 headers that say nothing but for one, with vectors: an embedding moved towards that of its label by 0 to 2."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    names = spark.createDataFrame([(i, f) for i, f in enumerate(M.FIELD_IDS)], "i int, field_id string")
    moved = F.zip_with("embedding", "f", lambda a, b: a.cast("double") + (c("vec_id") % 5) * 0.5 * b.cast("double"))
    d = e.join(first, "label").select("vec_id", (c("vec_id") / 25).cast("int").cast("string").alias("file"), (c("vec_id") % 25).cast("int").alias("col_index"), moved.alias("vector"))
    blank = {"data_type": F.lit("numeric"), "fill_rate": F.lit(1.0), "rows": F.lit(10), "distinct": F.lit(10), "samples": F.array().cast("array<string>")} | {f"looks_{x}": F.lit(False) for x in ("moic", "irr", "currency", "date", "identifier")}
    columns = d.select("file", "col_index", F.when(c("col_index") == 7, "Gross MOIC").otherwise(F.concat(F.lit("zq"), "vec_id")).alias("col_name")).withColumns(blank)
    fields = first.join(names, c("label") == c("i")).select("field_id", c("f").alias("field_vector"))
    return columns, (d.select("file", "col_index", "vector"), fields)


def _semantic_mapping(spark, sf):
    columns, vectors = _vector_columns(spark, sf)
    found = M.mapping(columns, vectors).where("col_index IS NOT NULL")
    return found.select("file", "field_id", "col_name", F.round("confidence", 5).alias("confidence"), F.array_join("signals", ",").alias("signals"))


QUERIES["D8_D11_semantic_mapping"] = _semantic_mapping
_ids = ", ".join(f"({i}, '{f}')" for i, f in enumerate(M.FIELD_IDS))
# The headers say nothing, so all scores but those of column 7 are 0.85 of a cosine; that column is certain of its field.
# Columns of numbers are a tenth as likely companies.
ORACLE_SQL["D8_D11_semantic_mapping"] = f"""WITH RECURSIVE f AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS f FROM embeddings GROUP BY label), names(i, field_id) AS (VALUES {_ids}),
  v AS (SELECT vec_id, (vec_id // 25)::VARCHAR AS file, (vec_id % 25)::INTEGER AS col_index, list_transform(list_zip(embedding::DOUBLE[], f), lambda x: x[1] + (vec_id % 5) * 0.5::DOUBLE * x[2]) AS v FROM embeddings JOIN f USING (label)),
  s AS (SELECT file, col_index, field_id, i, 'zq' || vec_id AS col_name, CASE WHEN field_id = 'company' THEN 0.1::DOUBLE ELSE 1 END * 0.85::DOUBLE * list_dot_product(v, f) / sqrt(list_dot_product(v, v) * list_dot_product(f, f)) AS conf, 'semantic' AS signals FROM v, f JOIN names ON f.label = names.i WHERE col_index <> 7
    UNION ALL SELECT DISTINCT file, 7, 'gross_moic', {M.FIELD_IDS.index('gross_moic')}, 'Gross MOIC', 0.95::DOUBLE, 'alias,pattern,tokens' FROM v WHERE col_index = 7),
  items AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY conf DESC, i, col_index) AS k FROM s WHERE conf >= 0.5),
  steps(file, k, fields, cols) AS (SELECT DISTINCT file, 0::BIGINT, []::VARCHAR[], []::INTEGER[] FROM items UNION ALL SELECT g.file, x.k, CASE WHEN list_contains(fields, field_id) OR list_contains(cols, col_index) THEN fields ELSE list_append(fields, field_id) END,
    CASE WHEN list_contains(fields, field_id) OR list_contains(cols, col_index) THEN cols ELSE list_append(cols, col_index) END FROM steps g JOIN items x ON x.file = g.file AND x.k = g.k + 1),
  picked AS (SELECT file, unnest(fields) AS field_id, unnest(cols) AS col_index FROM (SELECT file, arg_max(fields, k) AS fields, arg_max(cols, k) AS cols FROM steps GROUP BY file))
  SELECT file, field_id, col_name, round(conf, 5) AS confidence, signals FROM picked JOIN items USING (file, field_id, col_index)"""
ORACLE_SQL |= TWINS
ORACLE_SQL["D8_semantic"] = """WITH m AS (SELECT label, list(m ORDER BY pos) AS f FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label),
  p AS (SELECT vec_id AS key, label::VARCHAR AS field_id, list_dot_product(embedding::DOUBLE[], f) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(f, f)) AS cos FROM (SELECT vec_id, embedding FROM embeddings) e, m)
  SELECT key, field_id, round(cos * 0.85, 5) AS confidence FROM p WHERE cos >= 0.45 QUALIFY row_number() OVER (PARTITION BY key ORDER BY cos DESC, field_id DESC) = 1"""


def _by_hand(mapped):
    """A reviewer's choice of the company column, whose repeated names inference does not take."""
    return mapped.select("file", F.lit("company").alias("field_id"), F.lit("Portfolio Company (a)").alias("column")).distinct()


def _stored(spark, sf):
    """Every manager's columns stored and loaded again; one choice by hand wins over the inferred column."""
    where = folder(spark, "mappings")
    mapped = M.mapping(_profiles(spark, sf))
    M.save_mapping(mapped, c("file"), where)
    loaded = M.load_mapping(spark, where).select("file", "field_id", "column")
    hand = _by_hand(mapped)
    kept = loaded.join(hand, ["file", "field_id"], "left_anti").unionByName(hand)
    return M.overridden(mapped.withColumn("col_name", F.lit(None).cast("string")), kept).where("col_name IS NOT NULL").select(M.slug(c("file")).alias("slug"), "file", "field_id", "col_name")


QUERIES["A11_stored_mapping"] = _stored
ORACLE_SQL["A11_stored_mapping"] = f"{ORACLE_SQL['D14_mapping_log'].rsplit('SELECT file, label', 1)[0]} SELECT replace(lower(file), ' ', '_') AS slug, file, field_id, CASE WHEN field_id = 'company' THEN 'Portfolio Company (a)' ELSE col_name END AS col_name FROM mapped WHERE col_name IS NOT NULL OR field_id = 'company'"

# ---- discovery
_merges = X.landed_merges
_found = lambda spark, sf: B.candidates(_cells(spark, sf), _merges(spark), _rows(spark, sf))
QUERIES["B1_B2_sheet_profiles"] = lambda spark, sf: B.sheet_profiles(_cells(spark, sf)).select("file_id", "sheet", "min_row", "max_row", "min_col", "max_col", F.round("empty", 6).alias("empty"))
ORACLE_SQL["B1_B2_sheet_profiles"] = lambda: f"WITH {_WHOLE} SELECT file_id, sheet, 1 AS min_row, max(r + 4)::INTEGER AS max_row, 2 AS min_col, {_WIDTH + 1} AS max_col, round(1 - (sum(filled) + {_WIDTH} + 3) / (max(r + 4) * {_WIDTH}), 6)::DOUBLE AS empty FROM seen GROUP BY 1, 2"
# The twin of this one query ends where a profiler's scan does; B4_whole_sheets goes on.
QUERIES["B3_B5_blocks"] = lambda spark, sf: B.tables(B.scanned(_cells(spark, sf))).select("file_id", "sheet", "first_row", "last_row", "first_col", "last_col")
ORACLE_SQL["B3_B5_blocks"] = f"{_SHEETS} SELECT gp_name AS file_id, fund || ' - Deal Data' AS sheet, 4 AS first_row, least(count(*) + 4, 2000)::INTEGER AS last_row, 2 AS first_col, {len(X.SHEET_HEADERS) + 1} AS last_col FROM raw WHERE fund IS NOT NULL GROUP BY gp_name, fund"
QUERIES["B4_whole_sheets"] = lambda spark, sf: B.blocks_by_ranges(_cells(spark, sf)).select("file_id", "sheet", "first_row", "last_row", "first_col", "last_col")
ORACLE_SQL["B4_whole_sheets"] = ORACLE_SQL["B3_B5_blocks"].replace("least(count(*) + 4, 2000)", "(count(*) + 4)")
QUERIES["B6_B12_primary"] = lambda spark, sf: B.primary_tables(_found(spark, sf), _cells(spark, sf)).select("file_id", "sheet", "rows", "cols", "orientation", "likely", F.round("score", 4).alias("score"))
_KIND = {"entry_date": "d", "exit_date": "d"} | dict.fromkeys(("total_ic", "realized", "gross_tvpi", "current_value", "entry_rev", "entry_ebitda", "entry_ev"), "n")
_filled = lambda kind: " + ".join(f"({x} IS NOT NULL)::INTEGER" for x, _ in X.SHEET_HEADERS if kind is None or _KIND.get(x, "s") == kind)
_cell = lambda x: "'www.' || lower(geography) || '.com'" if x == "geography" else f"{x}::VARCHAR"
_WIDTH = len(X.SHEET_HEADERS)
# Deals at the top of a sheet that are mostly text read as further header rows, k of them at most four.
_SEEN = f"""{Q.DEAL_LIST}, seen AS (SELECT *, gp_name AS file_id, fund || ' - Deal Data' AS sheet, row_number() OVER (PARTITION BY gp_name, fund ORDER BY deal_id) AS r, least(count(*) OVER (PARTITION BY gp_name, fund), {B.MAX_ROWS - 4}) AS cnt,
    {_filled(None)} AS filled, {_filled("s")} AS texts, {_filled("n")} AS numbers FROM raw WHERE fund IS NOT NULL),
  heads AS (SELECT file_id, sheet, coalesce(min(r) FILTER (r <= least(4, cnt - 1) AND NOT (filled >= 0.2 * {_WIDTH} AND texts >= 0.45 * filled AND numbers < 0.4 * filled)), least(4, max(cnt) - 1) + 1) - 1 AS k FROM seen GROUP BY file_id, sheet),
  body AS (SELECT * FROM seen JOIN heads USING (file_id, sheet)),
  parts AS (SELECT file_id, sheet, 0 AS r, unnest(range(2, {_WIDTH + 2})) AS col_no, unnest({[h for _, h in X.SHEET_HEADERS]}) AS v FROM heads
    UNION ALL SELECT file_id, sheet, r, unnest(range(2, {_WIDTH + 2})), unnest([{", ".join(_cell(x) for x, _ in X.SHEET_HEADERS)}]) FROM body WHERE r <= k),
  labels AS (SELECT file_id, sheet, col_no, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), ' | ') AS header FROM (SELECT file_id, sheet, col_no, list(v ORDER BY r) AS l FROM parts WHERE v IS NOT NULL GROUP BY 1, 2, 3))"""
# Rows are counted to the end of a sheet.
_WHOLE = _SEEN.replace(f"least(count(*) OVER (PARTITION BY gp_name, fund), {B.MAX_ROWS - 4})", "count(*) OVER (PARTITION BY gp_name, fund)")
ORACLE_SQL["B6_B12_primary"] = f"""WITH {_WHOLE}, g AS (SELECT file_id, sheet, count(*)::INTEGER AS rows, {_WIDTH} AS cols, sum(filled) AS n, max((coalesce(entry_date, exit_date) IS NOT NULL)::INTEGER) AS has_date, max((numbers > 0)::INTEGER) AS has_number, max(CASE WHEN r = k + 1 THEN numbers / (filled - 1) END) AS row_num FROM body WHERE r > k GROUP BY 1, 2),
  h AS (SELECT file_id, sheet, len(list_filter({list(DEAL_KEYWORDS)}, lambda w: contains(t, w))) AS hits FROM (SELECT file_id, sheet, lower(string_agg(header, ' ' ORDER BY col_no)) AS t FROM labels GROUP BY 1, 2)),
  o AS (SELECT *, CASE WHEN row_num > 0.5 THEN 'col_per_record' ELSE 'row_per_record' END AS orientation, hits >= 3 AND rows >= 3 AS likely FROM g JOIN h USING (file_id, sheet)),
  p AS (SELECT *, greatest(0, least(100, least(25, 8 * ln(1 + rows)) + least(20, 2.0 * cols) + 15 * least(1, n / (rows * cols)) + 10 * has_date + 10 * has_number + least(20, 2.0 * hits) - CASE WHEN orientation = 'col_per_record' THEN 10 ELSE 0 END)) AS s FROM o)
  SELECT file_id, sheet, rows, cols, orientation, likely, round(s::DOUBLE, 4) AS score FROM p QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY s DESC, sheet) = 1"""
ORACLE_SQL["B7_B8_headers"] = f"WITH {_SEEN} SELECT file_id, sheet, col_no::INTEGER AS col_no, header FROM labels"
ORACLE_SQL["B22_widest_row"] = f"WITH {_SEEN}, w AS (SELECT file_id, sheet, r + 4 AS row_no, filled FROM seen WHERE r <= 26 UNION ALL SELECT file_id, sheet, 4, {_WIDTH} FROM heads) SELECT file_id, sheet, arg_min(row_no, struct_pack(a := -filled, b := row_no))::INTEGER AS header_row FROM w GROUP BY 1, 2"
ORACLE_SQL["A1_table_rows"] = f"WITH {_SEEN} SELECT file_id, count(*) AS rows, sum(filled)::BIGINT AS cells FROM body WHERE r > k GROUP BY 1"
QUERIES["B7_B8_headers"] = lambda spark, sf: B.headers(_cells(spark, sf), _merges(spark), B.tables(_rows(spark, sf))).select("file_id", "sheet", "col_no", "header")
QUERIES["B13_layouts"] = lambda spark, sf: B.layouts(_found(spark, sf), _cells(spark, sf)).select("file_id", "layout", F.array_join("sheets", ";").alias("sheets"))
ORACLE_SQL["B13_layouts"] = f"{_SHEETS} SELECT file_id, 'per_fund' AS layout, string_agg(sheet, ';' ORDER BY sheet) AS sheets FROM sheets GROUP BY file_id"
QUERIES["B14_B16_metadata"] = lambda spark, sf: B.metadata(_cells(spark, sf)).select("file_id", F.array_join("gp_names", ";").alias("gp_names"), "currency")
ORACLE_SQL["B14_B16_metadata"] = f"{_SHEETS} SELECT DISTINCT file_id, file_id || ';Alpha;As of 30/09/2025;Portfolio Company (a);Investment Date' AS gp_names, 'USD' AS currency FROM sheets"
QUERIES["B17_B19_as_of"] = lambda spark, sf: B.track_record_dates(_cells(spark, sf))
ORACLE_SQL["B17_B19_as_of"] = f"{_SHEETS} SELECT DISTINCT file_id, DATE '2025-09-30' AS as_of FROM sheets"
QUERIES["B20_unit_banner"] = lambda spark, sf: B.unit_banner(_cells(spark, sf))
ORACLE_SQL["B20_unit_banner"] = f"{_SHEETS} SELECT DISTINCT file_id, 'm' AS banner FROM sheets"
QUERIES["B21_sheet_scores"] = lambda spark, sf: B.sheet_scores(_cells(spark, sf))
ORACLE_SQL["B21_sheet_scores"] = f"{_SHEETS} SELECT file_id, sheet, (row_number() OVER (PARTITION BY file_id ORDER BY sheet) - 1)::INTEGER AS sheet_idx, 1 AS score, row_number() OVER (PARTITION BY file_id ORDER BY sheet) = 1 AS is_main, true AS is_deal_sheet FROM sheets"
QUERIES["B22_widest_row"] = lambda spark, sf: B.widest_row(_cells(spark, sf))
QUERIES["B23_banner_meta"] = lambda spark, sf: B.banner_meta(_cells(spark, sf), B.tables(_rows(spark, sf))).select("file_id", "sheet", "report_date", "gp_name")
ORACLE_SQL["B23_banner_meta"] = f"{_SHEETS} SELECT file_id, sheet, NULL::DATE AS report_date, 'Alpha Capital' AS gp_name FROM sheets"
QUERIES["A1_table_rows"] = lambda spark, sf: B.table_rows(_cells(spark, sf), _merges(spark), B.tables(_rows(spark, sf))).groupBy("file_id").agg(F.count("*").alias("rows"), F.sum(F.size("vals")).alias("cells"))
_INPUT = lambda spark, sf: B.input_grid(_cells(spark, sf).where("row_no >= 4").withColumn("value", F.when(c("row_no") == 4, F.regexp_replace("value", r"Portfolio Company \(a\)", "Company")).otherwise(c("value"))).withColumn("file_id", F.concat_ws("/", "file_id", "sheet")))
QUERIES["A2_input_grid"] = lambda spark, sf: _INPUT(spark, sf).groupBy("file_id").agg(F.count_distinct("row_no").alias("rows"))
ORACLE_SQL["A2_input_grid"] = f"{_SHEETS} SELECT gp_name || '/' || fund || ' - Deal Data' AS file_id, count(*) AS rows FROM raw WHERE fund IS NOT NULL GROUP BY gp_name, fund"
QUERIES["A3_header_differences"] = lambda spark, sf: B.header_differences(_INPUT(spark, sf), ["Company", "Fund", "Status"]).select("file_id", F.array_join("missing", ",").alias("missing"), F.size("unknown").alias("n_unknown"))
ORACLE_SQL["A3_header_differences"] = f"{_SHEETS} SELECT gp_name || '/' || fund || ' - Deal Data' AS file_id, 'fund' AS missing, (11 - (count(exit_date) = 0)::INTEGER - (count(sector) = 0)::INTEGER - (count(gross_tvpi) = 0)::INTEGER)::INTEGER AS n_unknown FROM raw WHERE fund IS NOT NULL GROUP BY gp_name, fund"


# ---- banners and sheet names of many forms; the twins know each sheet's form by its number and read no text
_shapes = lambda spark, sf: X.shaped_cells(spark, sf)
_FORMS = f"WITH s AS ({X.SHAPES_SQL.format(supplier='supplier', nation='nation')}), v AS (SELECT * FROM s WHERE sheet_state = 'visible'), f AS (SELECT DISTINCT file_id, n FROM s)"
QUERIES["B14_B16_shapes"] = lambda spark, sf: B.metadata(_shapes(spark, sf)).select("file_id", F.array_join("gp_names", ";").alias("gp_names"), "currency")
_names = " UNION ALL ".join(f"SELECT file_id, sheet_idx, {r} AS r, {v} AS name FROM v" for r, k, t, v in X.SHAPES_CELLS if t == "s" and r < 5).replace(" || ' Capital Track Record'", "")
ORACLE_SQL["B14_B16_shapes"] = f"""{_FORMS}, c AS ({_names} UNION ALL SELECT file_id, sheet_idx, 5, '($000)' FROM v WHERE k % 5 = 3 UNION ALL SELECT file_id, -1, 0, file_id FROM f),
  d AS (SELECT file_id, name, min(sheet_idx * 10 + r) AS pos FROM c WHERE name IS NOT NULL GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS i FROM d),
  m AS (SELECT file_id, arg_min(CASE k % 5 WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 4 THEN 'GBP' END, sheet_idx) AS currency FROM v WHERE k % 5 IN (1, 2, 4) GROUP BY 1)
  SELECT file_id, string_agg(name, ';' ORDER BY i) AS gp_names, any_value(currency) AS currency FROM g LEFT JOIN m USING (file_id) WHERE i <= 5 GROUP BY file_id"""
QUERIES["B17_B19_shapes"] = lambda spark, sf: B.track_record_dates(_shapes(spark, sf))
_quarter = "last_day(make_date(2021, (k % 3 + 1)::INTEGER * 3, 1))"
ORACLE_SQL["B17_B19_shapes"] = f"""{_FORMS}, a AS (SELECT file_id, arg_min(CASE WHEN k % 4 < 2 THEN day ELSE {_quarter} END, sheet_idx) AS day FROM v WHERE k % 4 < 3 GROUP BY 1),
  b AS (SELECT file_id, arg_min(CASE WHEN k % 4 = 1 OR k % 4 <> 2 THEN day ELSE {_quarter} END, sheet_idx) AS day FROM v WHERE k % 4 IN (1, 2) OR k % 7 = 1 GROUP BY 1)
  SELECT f.file_id, coalesce(a.day, CASE n % 4 WHEN 2 THEN NULL WHEN 3 THEN DATE '2025-12-31' ELSE DATE '2025-09-30' END, b.day) AS as_of FROM f LEFT JOIN a USING (file_id) LEFT JOIN b USING (file_id)"""
QUERIES["B20_shapes"] = lambda spark, sf: B.unit_banner(_shapes(spark, sf))
ORACLE_SQL["B20_shapes"] = f"{_FORMS}, u AS (SELECT file_id, min(u) AS lo, max(u) AS hi FROM (SELECT file_id, CASE WHEN k % 5 IN (1, 4) THEN 'm' WHEN k % 5 IN (2, 3) THEN 'k' END AS u FROM v) GROUP BY 1) SELECT file_id, CASE WHEN lo = hi THEN lo END AS banner FROM f LEFT JOIN u USING (file_id)"
QUERIES["B21_shapes"] = lambda spark, sf: B.sheet_scores(_shapes(spark, sf))
_words = lambda words: f"len(list_filter({list(words)}, lambda w: contains(lower(sheet), w)))"
ORACLE_SQL["B21_shapes"] = f"""{_FORMS}, p AS (SELECT file_id, sheet, sheet_idx, (CASE WHEN k % 6 = 2 THEN 0 ELSE 2 * {_words(SHEET_KEYWORDS)} - {_words(SKIP_SHEETS)} + 1 END)::INTEGER AS score FROM s),
  q AS (SELECT *, max(score) OVER (PARTITION BY file_id) AS best, count(*) OVER (PARTITION BY file_id) AS n, max(sheet_idx) OVER (PARTITION BY file_id) AS last, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, sheet_idx) AS k FROM p)
  SELECT file_id, sheet, sheet_idx, score, CASE WHEN best <= 0 AND n > 1 THEN sheet_idx = last ELSE k = 1 END AS is_main, CASE WHEN best > 0 THEN score > 0 ELSE k = 1 END AS is_deal_sheet FROM q"""
QUERIES["B24_shapes"] = lambda spark, sf: B.visible(_shapes(spark, sf)).groupBy("file_id").agg(F.count_distinct("sheet").alias("sheets"), F.count("*").alias("cells"))
_count = " + ".join(f"({v} IS NOT NULL)::INTEGER" for *_, v in X.SHAPES_CELLS)
ORACLE_SQL["B24_shapes"] = f"{_FORMS} SELECT file_id, count(*) AS sheets, sum({_count} + 1)::BIGINT AS cells FROM v GROUP BY 1"
QUERIES["C2_shapes"] = lambda spark, sf: P.fund_labels(_shapes(spark, sf).select(c("file_id").alias("file"), "sheet").distinct())
ORACLE_SQL["C2_shapes"] = f"{_FORMS} SELECT file_id AS file, sheet, CASE WHEN count(*) OVER w >= 2 AND min((k % 6 = 3)::INTEGER) OVER w = 1 THEN 'Fund ' || k ELSE sheet END AS fund_label FROM s WINDOW w AS (PARTITION BY file_id)"


# ---- from grids to standard deals: one manager's sheets are in thousands, and a sheet's fund stands among its companies
def _shifted(spark, sf):
    cells = _cells(spark, sf)
    money = c("col_no").isin(*(i + 2 for i, (x, _) in enumerate(X.SHEET_HEADERS) if x in ("total_ic", "realized", "current_value", "entry_rev", "entry_ebitda", "entry_ev")))
    k = (c("file_id") == "GP_AMERICA") & money
    value = F.when(k & (c("row_no") == 4), F.concat(F.regexp_replace("value", r" \(\$m\)", ""), F.lit(" (k)"))).when(k & (c("row_no") > 4), (c("value").try_cast("decimal(24,7)") * 1000).cast("string")).otherwise(c("value"))
    return cells.withColumn("value", F.when((c("row_no") > 8) & (c("row_no") % 50 == 0) & (c("col_no") == 2), F.regexp_replace("sheet", " - Deal Data$", "")).otherwise(value))


def _standard(spark, sf):
    """Parse, map, scale, clean: F20 blanks companies that are funds, F23 brings thousands to millions."""
    cells = _shifted(spark, sf)
    # The shift changes what cells hold, not which are filled.
    h = saved(B.tables(_rows(spark, sf)).withColumns({"header_rows": F.array(F.lit(4)), "data_row": F.lit(5)}))
    labels = saved(P.fund_labels(cells.select(c("file_id").alias("file"), "sheet").distinct()))
    rows = B.table_rows(cells, _merges(spark), h).withColumnRenamed("file_id", "file").join(labels, ["file", "sheet"])
    names = saved(cells.where("row_no = 4").select(c("file_id").alias("file"), "sheet", "col_no", c("value").alias("col_name")))
    body = cells.where("row_no > 4").withColumnRenamed("file_id", "file").join(names, ["file", "sheet", "col_no"])
    profiles = P.column_profiles(body.select("file", (c("col_no") - 2).alias("col_index"), "col_name", (c("sheet_idx") * F.lit(1 << 32) + c("row_no")).alias("row_no"), "value"))
    mapped = M.mapping(saved(profiles))
    mapped = saved(M.overridden(mapped, _by_hand(mapped)))
    valued = saved(N.typed_rows(rows, mapped))
    scales = P.monetary_scale(N.monetary_values(valued), mapped.where("col_name IS NOT NULL").select("file", "field_id", "col_name"), B.unit_banner(cells.where("file_id <> 'GP_AMERICA'")).withColumnRenamed("file_id", "file"))
    out = N.standard_rows(valued, scales, labels.select("file", c("fund_label").alias("fund")))
    return out.select("file", "fund", "row_no", "company", "status", "entry_date", "exit_date", *(S.rounded(c(x), 3).alias(x) for x in ("ic_total", "realized", "unrealized", "gross_moic", "entry_ev")))


QUERIES["F20_F23_standard_rows"] = _standard
ORACLE_SQL["F20_F23_standard_rows"] = f"""WITH {_SEEN} SELECT file_id AS file, fund, (r + 4)::INTEGER AS row_no, CASE WHEN NOT ((r + 4) > 8 AND (r + 4) % 50 = 0) THEN company END AS company, {Q._STATUS} AS status, entry_date, exit_date,
  round(total_ic::DOUBLE, 3) AS ic_total, round(realized::DOUBLE, 3) AS realized, round(current_value::DOUBLE, 3) AS unrealized, round(gross_tvpi::DOUBLE, 3) AS gross_moic, round(entry_ev::DOUBLE, 3) AS entry_ev FROM seen"""
ORACLE_SQL["B1_B2_sheet_profiles"] = ORACLE_SQL["B1_B2_sheet_profiles"]()
