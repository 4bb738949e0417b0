"""Registered queries against their SQL twins, and properties of the reports."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from dealflow.plans import registry

#: One of each family; the driver compares all.
SAMPLE = ("R3_sector", "R18_all_cuts", "R21_fund_sector_share", "R31_vintage_sector_moic", "R44_growth_unrealized", "H21_H27_weighted", "F1_F5_parsed", "F6_F14_buckets", "V1_V12_issues", "P1_P7_gate", "E1_E10_deal_rows", "E4_fund_sections", "G1_monetary_scale", "C2_fund_labels", "C4_C5_profiles", "B13_layouts", "B17_B19_as_of", "X2_over_time", "S1_incremental_ingest", "E6_keep_first", "P3_P4_first_bad", "X6_browser", "D8_D11_semantic_mapping", "A2_A7_grid_to_snapshot", "B14_B16_shapes", "B17_B19_shapes", "B21_shapes", "B4_whole_sheets", "X3_overview", "A6_A7_inventory")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.9g}"
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    out = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert got == sorted([plain(r[names.index(c)]) for c in cols] for r in out.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shares_add_up(spark, sf):
    from dealflow.operators import reports as R
    from dealflow.plans.report_queries import deals

    out = R.share_matrix(deals(spark, sf).where("total_ic > 0"), "fund", "sector").groupBy("is_grand", "row_item").sum("share").collect()
    assert all(abs(r["sum(share)"] - 1) < 1e-4 for r in out)


def test_publishing_twice_changes_nothing(spark, tmp_path):
    from dealflow.operators import snapshots as A

    d = A.long_table(spark.createDataFrame([(1, "G/P", None), (2, "G/P", "EUR")], "deal_id long, gp_name string, fund_currency string"), "2020-01-31", "me", "2020-02-01 00:00:00", "f", "USD")
    assert [r.replaced for r in A.publish(d, f"{tmp_path}/s").collect()] == [False]
    assert [tuple(r) for r in A.publish(d, f"{tmp_path}/s").collect()] == [("G-P", "2020-01-31", True)]
    assert A.read_snapshots(spark, f"{tmp_path}/s").count() == 2
