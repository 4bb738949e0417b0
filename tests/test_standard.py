"""Rows of matched tables as standard deals, read once and not shuffled by file."""

import datetime

from pyspark.sql import functions as F

from dealflow.functions import scalars as S
from dealflow.operators import profile, standard

MAPPED = [("f", "company", "Name"), ("f", "ic_total", "Cost"), ("f", "entry_date", "In"), ("f", "status", "State"), ("f", "exit_ev", None), ("g", "company", "Firm")]
ROWS = [
    ("f", "Own", 5, {"Name": " Alpha ", "Cost": "1,500x", "In": "31/12/2020", "State": "sold", "Aside": "1"}),
    ("f", "Own", 6, {"Name": "Fund I", "Cost": "n/a", "In": "soon"}),
    ("g", "Own", 7, {"Firm": "Fund I", "Cost": "7"}),
    ("h", "Own", 8, {"Name": "no mapping"}),
]


def _typed(spark):
    rows = spark.createDataFrame(ROWS, "file string, fund_label string, row_no int, vals map<string,string>")
    return standard.typed_rows(rows, spark.createDataFrame(MAPPED, "file string, field_id string, col_name string"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_typed_and_scaled(spark):
    typed = _typed(spark)
    assert sorted(tuple(r) for r in standard.monetary_values(typed).collect()) == [("f", "ic_total", 1500.0)]
    scales = spark.createDataFrame([("f", "ic_total", 1e-3)], "file string, field_id string, factor double")
    funds = spark.createDataFrame([("f", " Fund I"), ("f", "Fund I"), ("f", "")], "file string, fund string")
    out = standard.standard_rows(typed, scales, funds)
    got = {r.row_no: (r.file, r.fund, r.company, r.status, r.entry_date, r.ic_total, r.exit_ev) for r in out.collect()}
    assert got == {5: ("f", "Own", "Alpha", "Realized", datetime.date(2020, 12, 31), 1.5, None), 6: ("f", "Own", None, "Unrealized", None, None, None), 7: ("g", "Own", "Fund I", "Unrealized", None, None, None)}


def test_rows_are_not_shuffled_by_file(spark, tmp_path):
    """Scales and funds come out of groups, whose size Spark does not know; rows must not meet them in a task a file."""
    typed = _typed(spark)
    typed.write.parquet(f"{tmp_path}/t")
    typed = spark.read.parquet(f"{tmp_path}/t")
    scales = spark.range(3_000_000).selectExpr("'f' AS file", "'ic_total' AS field_id", "id % 2 AS k").groupBy("file", "field_id").agg(F.max("k").cast("double").alias("factor"))
    funds = spark.range(3_000_000).selectExpr("'f' AS file", "'Fund I' AS fund").distinct()
    assert "Exchange hashpartitioning" not in _plan(standard.standard_rows(typed, scales, funds))


def test_scales_read_no_text(spark):
    typed = _typed(spark)
    assert {t for n, t in typed.dtypes if n in standard.MONETARY} == {"double"}


def test_numbers_and_profiles_of_odd_text(spark):
    texts = ["1,234.5x", "12xx", "x", "x5", "5x%", "NaN", "nan", "inf", "-Infinity", "1e3", " 7 ", "0x10", "#REF!", "n/a", "2020-01-31", "Beta", "india", ".5", "+3", "", None]
    d = spark.createDataFrame([("f", 0, "c", i, t) for i, t in enumerate(texts)], "file string, col_index int, col_name string, row_no long, value string")
    old = F.regexp_replace(F.regexp_replace(F.trim("value"), "[,%]", ""), "x+$", "").try_cast("double")
    old = F.when(~F.trim("value").isin(*S.NUMBER_BLANKS) & ~F.isnan(old), old)
    assert all(r[0] == r[1] for r in d.select(S.to_number(F.col("value")), old).collect())
    cast = F.trim("value").try_cast("double")
    want = d.where(~F.isnan(cast)).agg(F.count(cast), F.min(cast), F.max(cast)).first()
    got = profile.column_profiles(d).first()
    assert (got.value_min, got.value_max) == (want[1], want[2]) == (float("-inf"), float("inf"))
    first = profile.column_profiles(d.where("value IN ('1e3', '.5', '+3', ' 7 ', 'Beta', '2020-01-31')")).first()
    assert (first.value_min, first.value_max, first.value_mean) == (0.5, 1000.0, 1010.5 / 4)


def test_money_is_rounded_as_in_sql(spark):
    """517.2085 is a double below the half; F.round goes by its digits and gives 517.209."""
    assert spark.range(1).select(S.rounded(F.lit(517.2085), 3)).first()[0] == 517.208
