"""DuckDB twins of the deal list and the reports."""

from __future__ import annotations

from ..functions.scalars import SHOWS_MISSING, STATUS_FRAGMENTS, THRESHOLDS, bucket_labels
from ..operators.reports import CUTS, METRICS
from ..sources.fixtures import deals_sql


def bucket_sql(value: str, kind: str) -> str:
    labels = bucket_labels(kind)
    cases = " ".join(f"WHEN {value} <= {t} THEN '{x}'" for t, x in zip(THRESHOLDS[kind], labels))
    missing = "'n/a'" if kind in SHOWS_MISSING else "NULL"
    return f"CASE WHEN {value} IS NULL THEN {missing} {cases} ELSE '{labels[-1]}' END"


def _div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


_STATUS = "CASE " + " ".join(f"WHEN contains(lower(trim(status)), '{p}') THEN '{s}'" for p, s in STATUS_FRAGMENTS) + " ELSE 'Unrealized' END"
_M = "DECIMAL(24,7)"

DEAL_LIST = f"""
raw AS ({deals_sql()}),
a AS (SELECT * REPLACE ({_STATUS} AS status,
    CASE WHEN try_cast(replace(trim(fund_currency), ',', '') AS DOUBLE) IS NULL AND length(trim(fund_currency)) <= 12 AND trim(fund_currency) <> '' THEN trim(fund_currency) END AS fund_currency,
    CASE WHEN coi IS NULL THEN 'n/a' WHEN lower(trim(coi)) IN ('yes', 'y', 'true', '1') THEN 'Yes' ELSE 'No' END AS coi,
    CASE WHEN valuation_method NOT IN ('-', 'None', 'none') THEN valuation_method END AS valuation_method,
    coalesce(realized, 0)::{_M} AS realized),
  CASE WHEN realized IS NOT NULL OR current_value IS NOT NULL THEN coalesce(realized, 0) + coalesce(current_value, 0) END::{_M} AS total_value,
  company || '-' || fund AS deal_key, year(entry_date)::INTEGER AS vintage, year(exit_date)::INTEGER AS exit_year,
  (exit_date - entry_date)::DOUBLE / 365 AS hold_period, coalesce(total_ic, 0)::{_M} AS ic_weight, coalesce(total_ic, ic_initial) AS ic_for_bucket FROM raw),
b AS (SELECT *, {_div('total_value', 'total_ic')} AS gross_moic,
  {_div('entry_ebitda', 'entry_rev')} AS entry_margin, {_div('exit_ebitda', 'exit_rev')} AS exit_margin,
  {_div('entry_net_debt', 'entry_ebitda')} AS entry_leverage, {_div('exit_net_debt', 'exit_ebitda')} AS exit_leverage,
  entry_ev - entry_net_debt AS entry_equity, exit_ev - exit_net_debt AS exit_equity,
  {_div('entry_ev', 'entry_ebitda')} AS entry_multiple, {_div('exit_ev', 'exit_ebitda')} AS exit_multiple,
  {_div('entry_ev', 'entry_rev')} AS entry_ev_sales, {_div('exit_ev', 'exit_rev')} AS exit_ev_sales,
  CASE WHEN entry_rev > 0 AND exit_rev > 0 AND hold_period > 0 THEN pow(exit_rev::DOUBLE / entry_rev::DOUBLE, 1.0 / hold_period) - 1 END AS rev_cagr,
  CASE WHEN entry_ebitda > 0 AND exit_ebitda > 0 AND hold_period > 0 THEN pow(exit_ebitda::DOUBLE / entry_ebitda::DOUBLE, 1.0 / hold_period) - 1 END AS ebitda_cagr FROM a),
deals AS (SELECT *, {bucket_sql('hold_period', 'hold')} AS hold_bucket, {bucket_sql('ic_for_bucket', 'ic')} AS ic_bucket,
  {bucket_sql('gross_moic', 'moic')} AS moic_bucket, {bucket_sql('gross_irr', 'irr')} AS irr_bucket,
  {bucket_sql('entry_ebitda', 'ebitda')} AS ebitda_bucket, {bucket_sql('entry_rev', 'revenue')} AS revenue_bucket,
  {bucket_sql('entry_ev', 'entry_ev')} AS entry_ev_bucket, {bucket_sql('entry_multiple', 'entry_multiple')} AS multiple_bucket,
  {bucket_sql('entry_margin', 'entry_margin')} AS margin_bucket,
  CASE WHEN gross_moic < 1 THEN 1 END AS performing, CASE WHEN gross_moic < 1 THEN total_ic ELSE 0 END::{_M} AS ic_in_loss,
  CASE WHEN gross_moic < 1 THEN (1 - gross_moic) * ic_weight::DOUBLE ELSE 0 END::{_M} AS impaired_value, entry_multiple - entry_leverage AS equity_multiple FROM b)
"""

_P = "DECIMAL(30,7)"
WEIGHTED = f"""
weighted AS (SELECT *, CASE WHEN rev_cagr IS NOT NULL THEN ic_weight END AS rev_cagr_w, TRY_CAST(ic_weight::DOUBLE * rev_cagr AS {_P}) AS rev_cagr_p,
  CASE WHEN ebitda_cagr IS NOT NULL THEN ic_weight END AS ebitda_cagr_w, TRY_CAST(ic_weight::DOUBLE * ebitda_cagr AS {_P}) AS ebitda_cagr_p,
  CASE WHEN entry_margin IS NOT NULL THEN ic_weight END AS entry_margin_w, TRY_CAST(ic_weight::DOUBLE * entry_margin AS {_P}) AS entry_margin_p,
  CASE WHEN exit_margin IS NOT NULL THEN ic_weight END AS exit_margin_w, TRY_CAST(ic_weight::DOUBLE * exit_margin AS {_P}) AS exit_margin_p,
  CASE WHEN entry_multiple = 0 OR exit_multiple = 0 THEN 0 ELSE ic_weight END AS multiple_w,
  TRY_CAST((CASE WHEN entry_multiple = 0 OR exit_multiple = 0 THEN 0 ELSE ic_weight END)::DOUBLE * entry_multiple AS {_P}) AS entry_multiple_p,
  TRY_CAST((CASE WHEN entry_multiple = 0 OR exit_multiple = 0 THEN 0 ELSE ic_weight END)::DOUBLE * exit_multiple AS {_P}) AS exit_multiple_p,
  CASE WHEN entry_leverage IS NOT NULL AND exit_leverage IS NOT NULL THEN ic_weight ELSE 0 END AS leverage_w,
  TRY_CAST((CASE WHEN entry_leverage IS NOT NULL AND exit_leverage IS NOT NULL THEN ic_weight ELSE 0 END)::DOUBLE * entry_leverage AS {_P}) AS entry_leverage_p,
  TRY_CAST((CASE WHEN entry_leverage IS NOT NULL AND exit_leverage IS NOT NULL THEN ic_weight ELSE 0 END)::DOUBLE * exit_leverage AS {_P}) AS exit_leverage_p,
  CASE WHEN entry_ev_sales IS NOT NULL AND exit_ev_sales IS NOT NULL THEN ic_weight END AS ev_sales_w,
  CASE WHEN entry_ev_sales IS NOT NULL AND exit_ev_sales IS NOT NULL THEN TRY_CAST(ic_weight::DOUBLE * entry_ev_sales AS {_P}) END AS entry_ev_sales_p,
  CASE WHEN entry_ev_sales IS NOT NULL AND exit_ev_sales IS NOT NULL THEN TRY_CAST(ic_weight::DOUBLE * exit_ev_sales AS {_P}) END AS exit_ev_sales_p,
  TRY_CAST(ic_weight::DOUBLE * hold_period AS {_P}) AS hold_p FROM deals)
"""

POOLED = f"""count(*) AS deals, sum(ic_weight)::{_M} AS ic, round({_div('sum(coalesce(total_value, 0))', 'sum(ic_weight)')}, 6) AS moic,
  round({_div('sum(ic_in_loss)', 'sum(ic_weight)')}, 6) AS loss_ratio, round({_div('sum(impaired_value)', 'sum(ic_weight)')}, 6) AS impaired_ratio"""


def over_deals(body: str, weighted: bool = False) -> str:
    return f"WITH {DEAL_LIST}{', ' + WEIGHTED if weighted else ''} {body}"


def axis(name: str) -> str:
    return f"coalesce({name}::VARCHAR, 'n/a')" if name in ("vintage", "exit_year") else f"{name}::VARCHAR"


def cut(name: str, where: str = "true") -> str:
    return over_deals(f"SELECT grouping(item)::INTEGER AS is_total, item, {POOLED} FROM (SELECT *, {axis(name)} AS item FROM deals WHERE {where}) WHERE item IS NOT NULL GROUP BY ROLLUP (item)")


def all_cuts() -> str:
    return over_deals(" UNION ALL ".join(f"SELECT '{a}' AS axis, {axis(a)} AS item, {POOLED} FROM deals WHERE {axis(a)} IS NOT NULL GROUP BY 2" for a in dict.fromkeys(CUTS.values())))


def dispersion(by: str) -> str:
    return over_deals(f"SELECT grouping({by})::INTEGER AS is_total, {by} AS item, count(*) AS deals, round({_div('sum(ic_weight)', f'(SELECT sum(ic_weight) FROM deals WHERE {by} IS NOT NULL)')}, 6) AS ic_share, round(avg(gross_moic), 4) AS avg_moic FROM deals WHERE {by} IS NOT NULL GROUP BY ROLLUP ({by})")


def share_matrix(rows: str, cols: str, value: str = "ic_weight", of: str = "row", where: str = "true") -> str:
    part = "is_grand, row_item" if of == "row" else "is_grand, col_item"
    return over_deals(f"""SELECT is_grand, row_item, col_item, s::{_M} AS amount, round({_div('s', f'sum(s) OVER (PARTITION BY {part})')}, 6) AS share FROM
      (SELECT grouping(r)::INTEGER AS is_grand, r AS row_item, k AS col_item, sum({value}) AS s FROM (SELECT *, {axis(rows)} AS r, {axis(cols)} AS k FROM deals WHERE {where}) WHERE r IS NOT NULL AND k IS NOT NULL GROUP BY GROUPING SETS ((r, k), (k)))""")


def counts(name: str) -> str:
    return over_deals(f"SELECT is_total, item, deals, row_number() OVER (PARTITION BY is_total ORDER BY deals DESC, item)::INTEGER AS place FROM (SELECT grouping({name})::INTEGER AS is_total, {name} AS item, count(*) AS deals FROM deals WHERE {name} IS NOT NULL GROUP BY ROLLUP ({name}))")


def matrix(rows: str, cols: str, where: str = "true") -> str:
    return over_deals(f"SELECT grouping(r)::INTEGER AS all_rows, grouping(k)::INTEGER AS all_cols, r AS row_item, k AS col_item, count(*) AS deals, round({_div('sum(coalesce(total_value, 0))', 'sum(ic_weight)')}, 6) AS moic FROM (SELECT *, {axis(rows)} AS r, {axis(cols)} AS k FROM deals WHERE {where}) WHERE r IS NOT NULL AND k IS NOT NULL GROUP BY CUBE (r, k)")


def operating(kind: str, status: str | None = None) -> str:
    cols = ", ".join(f"round({_div(f'sum({p})', f'sum({w})')}, 6) AS {m}" for m, (w, p) in METRICS[kind].items())
    where = f"AND status = '{status}'" if status else ""
    return over_deals(f"SELECT grouping(fund)::INTEGER AS is_total, fund, {cols} FROM weighted WHERE fund IS NOT NULL {where} GROUP BY ROLLUP (fund)", weighted=True)
