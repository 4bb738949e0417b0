"""From raw deals to the deal list: file-level inference (G3 to G5) and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

c = F.col


def with_fund_vintage(deals: DataFrame) -> DataFrame:
    """fund_vintage, the earliest entry year of each fund; null without a fund."""
    first = deals.where("fund IS NOT NULL").groupBy("fund").agg(F.year(F.min("entry_date")).alias("fund_vintage"))
    return deals.join(first, "fund", "left")


def fund_aggregates(deals: DataFrame) -> DataFrame:
    """Invested, realized, unrealized and total value and the multiple of each fund; 0 where nothing is invested."""
    out = deals.where("fund IS NOT NULL").groupBy("fund").agg(*(F.sum(F.coalesce(x, F.lit(0))).alias(n) for x, n in (("total_ic", "ic"), ("realized", "realized"), ("current_value", "unrealized"))))
    out = out.withColumn("total", c("realized") + c("unrealized"))
    return out.withColumn("moic", F.round(F.coalesce(S.divide(c("total"), c("ic")), F.lit(0.0)), 6))


def run_summary(deals: DataFrame) -> DataFrame:
    """Numbers of deals, realized deals and funds."""
    return deals.agg(F.count("*").alias("deals"), F.count_if(c("status") == "Realized").alias("realized_deals"), F.count_distinct("fund").alias("funds"))


def returns(deals: DataFrame) -> DataFrame:
    """Dates, holds, values, multiples, losses and their buckets."""
    out = deals.withColumns(
        {
            "status": S.normalise_status(c("status")),
            "fund_currency": S.currency_guard(c("fund_currency")),
            "coi": S.coi_flag(c("coi")),
            "valuation_method": S.valuation_method(c("valuation_method")),
            "deal_key": S.unique_id(c("company"), c("fund")),
            "vintage": F.year("entry_date"),
            "exit_year": F.year("exit_date"),
            "hold_period": S.hold_period(c("entry_date"), c("exit_date")),
            "ic_weight": F.coalesce("total_ic", F.lit(0)).cast("decimal(24,7)"),
            "ic_for_bucket": F.coalesce("total_ic", "ic_initial"),
            "total_value": F.when(c("realized").isNotNull() | c("current_value").isNotNull(), F.coalesce("realized", F.lit(0)) + F.coalesce("current_value", F.lit(0))).cast("decimal(24,7)"),
            "realized": F.coalesce("realized", F.lit(0)).cast("decimal(24,7)"),
        }
    )
    out = out.withColumn("gross_moic", S.divide(c("total_value"), c("total_ic")))
    loss = F.coalesce(c("gross_moic") < 1, F.lit(False))
    return out.withColumns(
        {
            "hold_bucket": S.bucket(c("hold_period"), "hold"),
            "ic_bucket": S.bucket(c("ic_for_bucket"), "ic"),
            "moic_bucket": S.bucket(c("gross_moic"), "moic"),
            "irr_bucket": S.bucket(c("gross_irr"), "irr"),
            "performing": F.when(loss, 1),
            "ic_in_loss": F.when(loss, c("total_ic")).otherwise(0).cast("decimal(24,7)"),
            "impaired_value": F.when(loss, (1 - c("gross_moic")) * c("ic_weight").cast("double")).otherwise(0.0).cast("decimal(24,7)"),
        }
    )


def operating(deals: DataFrame) -> DataFrame:
    """Margins, leverage, equity and multiples at entry and exit, and their buckets."""
    cols = {}
    for at in ("entry", "exit"):
        rev, ebitda, debt, ev = (c(f"{at}_{x}") for x in ("rev", "ebitda", "net_debt", "ev"))
        cols |= {
            f"{at}_margin": S.divide(ebitda, rev),
            f"{at}_leverage": S.divide(debt, ebitda),
            f"{at}_equity": ev - debt,
            f"{at}_multiple": S.divide(ev, ebitda),
            f"{at}_ev_sales": S.divide(ev, rev),
        }
    out = deals.withColumns(cols)
    return out.withColumns(
        {
            "equity_multiple": c("entry_multiple") - c("entry_leverage"),
            "ebitda_bucket": S.bucket(c("entry_ebitda"), "ebitda"),
            "revenue_bucket": S.bucket(c("entry_rev"), "revenue"),
            "entry_ev_bucket": S.bucket(c("entry_ev"), "entry_ev"),
            "multiple_bucket": S.bucket(c("entry_multiple"), "entry_multiple"),
            "margin_bucket": S.bucket(c("entry_margin"), "entry_margin"),
        }
    )


def _product(w, x):
    """Null beyond 23 digits, as growth over a hold of days can be."""
    return S.to_decimal(w.cast("double") * x)


def weighted(deals: DataFrame) -> DataFrame:
    """Growth, and weights and products of the operating metrics."""
    w = c("ic_weight")
    out = deals.withColumns({"rev_cagr": S.cagr(c("entry_rev"), c("exit_rev"), c("hold_period")), "ebitda_cagr": S.cagr(c("entry_ebitda"), c("exit_ebitda"), c("hold_period"))})
    zero = F.lit(0).cast("decimal(24,7)")
    cols = {
        "multiple_w": F.when((c("entry_multiple") == 0) | (c("exit_multiple") == 0), zero).otherwise(w),
        "leverage_w": F.when(c("entry_leverage").isNotNull() & c("exit_leverage").isNotNull(), w).otherwise(zero),
        "hold_p": _product(w, c("hold_period")),
    }
    for m in ("rev_cagr", "ebitda_cagr"):
        cols |= {f"{m}_w": F.when(c(m).isNotNull(), w), f"{m}_p": _product(w, c(m))}
    for at in ("entry", "exit"):
        cols[f"{at}_margin_p"] = _product(w, c(f"{at}_margin"))
        cols[f"{at}_margin_w"] = F.when(c(f"{at}_margin").isNotNull(), w)
    out = out.withColumns(cols)
    more = {}
    for at in ("entry", "exit"):
        more[f"{at}_multiple_p"] = _product(c("multiple_w"), c(f"{at}_multiple"))
        more[f"{at}_leverage_p"] = _product(c("leverage_w"), c(f"{at}_leverage"))
    both = c("entry_ev_sales").isNotNull() & c("exit_ev_sales").isNotNull()
    more["ev_sales_w"] = F.when(both, w)
    for at in ("entry", "exit"):
        more[f"{at}_ev_sales_p"] = F.when(both, _product(w, c(f"{at}_ev_sales")))
    return out.withColumns(more)


def deal_list(deals: DataFrame) -> DataFrame:
    """All derived columns in one projection."""
    return deals.transform(returns).transform(operating).transform(weighted)


def first_seen(deals: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values in the order in which they are first seen, numbered from 1."""
    seen = deals.where(c(col).isNotNull()).groupBy(col).agg(F.min(order).alias("first_seen"))
    return seen.withColumn("place", F.row_number().over(Window.orderBy("first_seen")))


# Headers of the deal-input table in order, and the columns they show.
INPUT_COLUMNS = (
    ("Company", "company"), ("Fund", "fund"), ("Status", "status"), ("Fund Currency", "fund_currency"), ("Inv. Date", "entry_date"), ("Exit Date", "exit_date"), ("Sector", "sector"), ("Geography", "geography"),
    ("Total Invested Capital (mlns)", "total_ic"), ("Realized Value", "realized"), ("Current Value", "current_value"), ("Transaction Type", "transaction_type"), ("GP Role", "gp_role"), ("Process Type", "process_type"),
    ("Sourcing Partner", "sourcing_partner"), ("Exit Type", "exit_type"), ("COI Deal (Yes/No)", "coi"), ("Gross TVPI", "gross_tvpi"), ("Gross IRR", "gross_irr"), ("Valuation Method", "valuation_method"),
    ("Entry LTM Revenue", "entry_rev"), ("Entry LTM EBITDA", "entry_ebitda"), ("Entry Net Debt", "entry_net_debt"), ("Entry Enterprise Value", "entry_ev"),
    ("Exit LTM Revenue", "exit_rev"), ("Exit LTM EBITDA", "exit_ebitda"), ("Exit Net Debt", "exit_net_debt"), ("Exit Enterprise Value", "exit_ev"),
)


def input_table(deals: DataFrame, currency: str | None = None) -> DataFrame:
    """The 28 columns of the deal-input table; missing currencies are the file's, missing realized values 0."""
    show = {"fund_currency": F.coalesce("fund_currency", F.lit(currency)), "realized": F.coalesce("realized", F.lit(0)).cast("decimal(24,7)")}
    return deals.select(*(show.get(x, c(x)).alias(h) for h, x in INPUT_COLUMNS))
