"""Registered queries over the deal list: G3 to G5, H, R and X families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deals as D
from ..functions import scalars as S
from ..operators import reports as R
from ..sources.fixtures import deals_raw
from . import sql as Q
from .inputs import folder

QUERIES, ORACLE_SQL, REPORTS = {}, {}, {}


def deals(spark, sf_dir, weights: bool = False):
    d = deals_raw(spark, sf_dir)
    return D.deal_list(d) if weights else d.transform(D.returns).transform(D.operating)


def add(name, run, sql, weights: bool = False):
    QUERIES[name] = lambda spark, sf_dir: run(deals(spark, sf_dir, weights))
    ORACLE_SQL[name] = sql
    if name.startswith("R"):
        REPORTS[name] = run


for _name, _axis in R.CUTS.items():
    add(_name, lambda d, a=_axis: R.cut(d, a), Q.cut(_axis))
add("R2_filtered_sector", lambda d: R.cut(d, "sector", status=("Realized",), hold_bucket=("<=2 yrs", ">=8 yrs")), Q.cut("sector", "status = 'Realized' AND hold_bucket IN ('<=2 yrs', '>=8 yrs')"))
add("R18_all_cuts", R.all_cuts, Q.all_cuts())
add("R19_moic_dispersion", lambda d: R.dispersion(d, "moic_bucket"), Q.dispersion("moic_bucket"))
add("R20_irr_dispersion", lambda d: R.dispersion(d, "irr_bucket"), Q.dispersion("irr_bucket"))
add("R21_fund_sector_share", lambda d: R.share_matrix(d, "fund", "sector"), Q.share_matrix("fund", "sector"))
add("R22_fund_geography_share", lambda d: R.share_matrix(d, "fund", "geography"), Q.share_matrix("fund", "geography"))
for _name, _axis in (("R23_count_sector", "sector"), ("R24_count_geography", "geography"), ("R25_count_transaction_type", "transaction_type"), ("R26_count_gp_role", "gp_role"), ("R27_count_process_type", "process_type")):
    add(_name, lambda d, a=_axis: R.counts(d, a), Q.counts(_axis))
add("R28_deal_count", R.deal_count, Q.over_deals("SELECT count(*) AS deals FROM deals"))
add("R29_vintage", lambda d: R.cut(d, "vintage", fund=None), Q.cut("vintage"))
add("R30_vintage_sector", lambda d: R.matrix(d, "vintage", "sector").drop("moic"), Q.matrix("vintage", "sector").replace("SELECT grouping(r)", "SELECT * EXCLUDE moic FROM (SELECT grouping(r)") + ")")
add("R31_vintage_sector_moic", lambda d: R.matrix(d, "vintage", "sector"), Q.matrix("vintage", "sector"))
add("R32_vintage_sector_by_fund", lambda d: R.matrix(R.filtered(d, fund=("ASIA Fund BUILDING",)), "vintage", "sector"), Q.matrix("vintage", "sector", "fund = 'ASIA Fund BUILDING'"))
add("R33_deployment", lambda d: R.share_matrix(d, "vintage", "fund", of="col"), Q.share_matrix("vintage", "fund", of="col"))
add("R34_vintage_fund", lambda d: R.matrix(d, "vintage", "fund"), Q.matrix("vintage", "fund"))
add("R35_exit_share", lambda d: R.share_matrix(d.where("status = 'Realized' AND exit_year IS NOT NULL"), "fund", "exit_year", value="ic_for_bucket"), Q.share_matrix("fund", "exit_year", "ic_for_bucket", where="status = 'Realized' AND exit_year IS NOT NULL"))
add("R36_exit_count", lambda d: R.matrix_counts(d.where("status = 'Realized' AND exit_year IS NOT NULL"), "fund", "exit_year"), Q.over_deals("SELECT fund AS row_item, exit_year::VARCHAR AS col_item, count(*) AS deals FROM deals WHERE status = 'Realized' AND exit_year IS NOT NULL AND fund IS NOT NULL GROUP BY 1, 2"))
add("R37_visible_axes", lambda d: d.where("fund IS NOT NULL AND sector IS NOT NULL").select("fund", "vintage").distinct(), Q.over_deals("SELECT DISTINCT fund, vintage FROM deals WHERE fund IS NOT NULL AND sector IS NOT NULL"))
add("R38_underperforming", R.underperforming, Q.over_deals(f"SELECT grouping(fund, company)::INTEGER AS level, fund, company, count(*) AS loss_deals, round({Q._div('sum(total_value)', 'sum(ic_weight)')}, 6) AS moic, sum(coalesce(current_value, 0))::DECIMAL(24,7) AS current_value, round({Q._div('sum(impaired_value)', 'sum(ic_weight)')}, 6) AS impaired_ratio, round(avg(hold_period), 4) AS avg_hold FROM deals WHERE performing = 1 AND fund IS NOT NULL AND company IS NOT NULL GROUP BY ROLLUP (fund, company)"))
add("R39_partner_attribution", R.partner_attribution, Q.over_deals(f"SELECT is_total, item, deals, moic, row_number() OVER (PARTITION BY is_total ORDER BY lower(item))::INTEGER AS place FROM (SELECT grouping(item)::INTEGER AS is_total, item, {Q.POOLED} FROM (SELECT *, sourcing_partner AS item FROM deals) WHERE item IS NOT NULL GROUP BY ROLLUP (item))"))
for _i, _kind in enumerate(R.METRICS):
    add(f"R{40 + _i}_{_kind}", lambda d, k=_kind: R.operating_by_fund(d, k), Q.operating(_kind), weights=True)
    add(f"R{44 + _i}_{_kind}_unrealized", lambda d, k=_kind: R.operating_by_fund(d, k, "Unrealized"), Q.operating(_kind, "Unrealized"), weights=True)
add("R48_realized_by_fund", R.realized_by_fund, Q.over_deals(f"SELECT grouping(fund)::INTEGER AS is_total, fund, sum(realized)::DECIMAL(24,7) AS realized, sum(coalesce(current_value, 0))::DECIMAL(24,7) AS current_value, round({Q._div('sum(coalesce(current_value, 0))', 'sum(realized) + sum(coalesce(current_value, 0))')}, 6) AS unrealized_share FROM deals WHERE fund IS NOT NULL GROUP BY ROLLUP (fund)"))
add("R49_hold_by_fund", R.hold_by_fund, Q.over_deals(f"SELECT grouping(fund)::INTEGER AS is_total, fund, round({Q._div('sum(hold_p)', 'sum(total_ic)')}, 6) AS weighted_hold FROM weighted WHERE status = 'Unrealized' AND fund IS NOT NULL GROUP BY ROLLUP (fund)", weighted=True), weights=True)
add("R50_chart_moic_dispersion", lambda d: R.chart_series(R.dispersion(d, "moic_bucket"), "ic_share", "avg_moic", hide_missing=True), f"SELECT item || chr(10) || deals::VARCHAR AS label, ic_share AS bar, avg_moic AS line FROM ({Q.dispersion('moic_bucket')}) WHERE is_total = 0 AND item <> 'n/a'")

_H = {
    "H1_pass_through": ("company fund fund_currency status entry_date exit_date sector geography total_ic realized current_value transaction_type gp_role process_type sourcing_partner exit_type coi gross_irr valuation_method", ""),
    "H2_H6_dates_and_weights": ("vintage exit_year hold_bucket ic_weight ic_bucket deal_key", "hold_period"),
    "H7_H12_returns": ("total_value moic_bucket performing ic_in_loss irr_bucket", "gross_moic impaired_value"),
    "H13_H20_operating": ("ebitda_bucket revenue_bucket entry_ev_bucket multiple_bucket margin_bucket entry_equity exit_equity", "entry_margin exit_margin entry_leverage exit_leverage entry_multiple exit_multiple equity_multiple entry_ev_sales exit_ev_sales"),
    "H21_H27_weighted": ("rev_cagr_w ebitda_cagr_w multiple_w leverage_w ev_sales_w entry_margin_w exit_margin_w", "rev_cagr ebitda_cagr rev_cagr_p ebitda_cagr_p entry_margin_p exit_margin_p hold_p entry_multiple_p exit_multiple_p entry_leverage_p exit_leverage_p entry_ev_sales_p exit_ev_sales_p"),
}
for _name, (_plain, _rounded) in _H.items():
    _w = _name.startswith("H21")
    add(
        _name,
        lambda d, p=_plain, r=_rounded: d.select("deal_id", *p.split(), *(S.rounded(F.col(x).cast("double"), 7 if x.endswith("_p") else 4).alias(x) for x in r.split())),
        Q.over_deals(f"SELECT deal_id, {', '.join(_plain.split() + [f"round({x}::DOUBLE, {7 if x.endswith('_p') else 4}) + 0.0 AS {x}" for x in _rounded.split()])} FROM {'weighted' if _w else 'deals'}", weighted=_w),
        weights=_w,
    )
add("G3_fund_vintage", lambda d: D.with_fund_vintage(d).select("deal_id", "fund", "fund_vintage"), Q.over_deals("SELECT deal_id, fund, fund_vintage FROM deals LEFT JOIN (SELECT fund, min(vintage) AS fund_vintage FROM deals WHERE fund IS NOT NULL GROUP BY fund) USING (fund)"))
add("G4_fund_aggregates", D.fund_aggregates, Q.over_deals(f"SELECT fund, sum(coalesce(total_ic, 0)) AS ic, sum(realized) AS realized, sum(coalesce(current_value, 0)) AS unrealized, sum(realized) + sum(coalesce(current_value, 0)) AS total, round(coalesce({Q._div('sum(realized) + sum(coalesce(current_value, 0))', 'sum(coalesce(total_ic, 0))')}, 0), 6) AS moic FROM deals WHERE fund IS NOT NULL GROUP BY fund"))
add("G5_run_summary", D.run_summary, Q.over_deals("SELECT count(*) AS deals, count(*) FILTER (status = 'Realized') AS realized_deals, count(DISTINCT fund) AS funds FROM deals"))
add("C6_first_seen_funds", lambda d: D.first_seen(d, "fund", "deal_id"), Q.over_deals("SELECT fund, min(deal_id) AS first_seen, row_number() OVER (ORDER BY min(deal_id))::INTEGER AS place FROM deals WHERE fund IS NOT NULL GROUP BY fund"))

# ---- items of the axes, all reports at once, the deal-input table
ITEM_AXES = (*dict.fromkeys(R.CUTS.values()), "hold_bucket", "moic_bucket", "irr_bucket", "exit_year")
add("C7_axis_items", lambda d: R.axis_items(d, ITEM_AXES), "")
_labels = " UNION ALL ".join(f"SELECT '{a}' AS axis, unnest({S.bucket_labels(k)}) AS item, generate_subscripts({S.bucket_labels(k)}, 1) AS rank" for a, k in R.BUCKETED.items())
ORACLE_SQL["C7_axis_items"] = Q.over_deals(
    f""", cell AS (SELECT deal_id, unnest({list(ITEM_AXES)}) AS axis, unnest([{", ".join(f"left(trim({a}::VARCHAR), 255)" for a in ITEM_AXES)}]) AS item FROM deals), found AS (SELECT axis, item, min(deal_id) AS first FROM cell WHERE item <> '' GROUP BY 1, 2), ranks AS ({_labels}),
    o AS (SELECT found.*, rank, axis IN {R.YEARS} AS years FROM found LEFT JOIN ranks USING (axis, item))
    SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY coalesce(rank, 1000), CASE WHEN years THEN try_cast(item AS BIGINT) END NULLS LAST, CASE WHEN years THEN item END, CASE WHEN NOT years THEN first END, item)::INTEGER AS place, item FROM o"""
)
#: The axes that each report reads: its cut, its matrix, and the columns that it filters by.
AXES = {n: (a,) for n, a in R.CUTS.items()} | {
    "R2_filtered_sector": ("sector", "status", "hold_bucket"), "R18_all_cuts": (), "R19_moic_dispersion": ("moic_bucket",), "R20_irr_dispersion": ("irr_bucket",), "R50_chart_moic_dispersion": ("moic_bucket",),
    "R21_fund_sector_share": ("fund", "sector"), "R22_fund_geography_share": ("fund", "geography"), "R23_count_sector": ("sector",), "R24_count_geography": ("geography",), "R25_count_transaction_type": ("transaction_type",),
    "R26_count_gp_role": ("gp_role",), "R27_count_process_type": ("process_type",), "R28_deal_count": ("status",), "R29_vintage": ("vintage",), "R30_vintage_sector": ("vintage", "sector"), "R31_vintage_sector_moic": ("vintage", "sector"),
    "R32_vintage_sector_by_fund": ("vintage", "sector", "fund"), "R33_deployment": ("vintage", "fund"), "R34_vintage_fund": ("vintage", "fund"), "R35_exit_share": ("fund", "exit_year", "status"), "R36_exit_count": ("fund", "exit_year", "status"),
    "R37_visible_axes": ("vintage", "sector", "fund"), "R38_underperforming": ("performing", "fund", "company"), "R39_partner_attribution": ("sourcing_partner",), "R48_realized_by_fund": ("fund",), "R49_hold_by_fund": ("fund", "status"),
} | {n: ("fund", "status") for n in REPORTS if n[:3] in ("R40", "R41", "R42", "R43", "R44", "R45", "R46", "R47")}
# R18 pools every cut at once, so its cells are the single deals of the other sets; the cuts themselves are R3 to R17.
CUBED = {n: run for n, run in REPORTS.items() if n != "R18_all_cuts"}
QUERIES["A10_all_reports"] = lambda spark, sf: R.write_reports(deals(spark, sf, True), CUBED, AXES_OF, folder(spark, "reports"))
AXES_OF = {n: AXES[n] for n in CUBED}
_cell = "coalesce(TRY_CAST(v AS DECIMAL(38,7))::VARCHAR, v, 'null')"
ORACLE_SQL["A10_all_reports"] = "SELECT report, name, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS report, name, {_cell} AS value FROM (SELECT COLUMNS(*)::VARCHAR FROM ({ORACLE_SQL[n]})) UNPIVOT INCLUDE NULLS (v FOR name IN (*))" for n in CUBED) + ") GROUP BY ALL"
QUERIES["A9_input_table"] = lambda spark, sf: D.input_table(deals(spark, sf), "USD")
ORACLE_SQL["A9_input_table"] = Q.over_deals("SELECT " + ", ".join({"fund_currency": "coalesce(fund_currency, 'USD')"}.get(x, x) + f' AS "{h}"' for h, x in D.INPUT_COLUMNS) + " FROM deals")
