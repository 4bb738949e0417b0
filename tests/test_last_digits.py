"""Numbers that have to agree with SQL to the last digit, as reports that are written as text do."""

import os
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from dealflow.functions import scalars as S
from dealflow.operators import deals as D
from dealflow.operators import reports as R
from dealflow.plans import registry

#: Doubles of every size up to the limit of the products, both signs; the first ones differed in sf0.1 under a plain cast.
PLACES = random.Random(3)
DOUBLES = [1.0305440705837215e18, 7.875651479605592e17, 7704613408064.64, 49791584250.75452, 89947765186.12074, 0.0, 0.5e-7, 1.5e-7, -2.5e-7, 0.1234565, 9.9e22, 1e23, 1e24, 1e30, float("nan"), float("inf"), None] + [
    PLACES.choice((-1, 1)) * PLACES.uniform(1, 10) * 10.0 ** PLACES.randrange(-8, 23) for _ in range(2000)
]


def test_decimals_and_rounding_as_in_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(DOUBLES)))
    want = con.execute("SELECT i, TRY_CAST(v AS DECIMAL(30,7))::VARCHAR, CASE WHEN isfinite(v) THEN round(v, 6) + 0.0 END FROM t ORDER BY i").fetchall()
    df = spark.createDataFrame(list(enumerate(DOUBLES)), "i int, v double").orderBy("i")
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    got = df.select("i", S.to_decimal(F.col("v")).cast("string"), F.when(finite, S.rounded(F.col("v"), 6))).collect()
    assert [tuple(r) for r in got] == [(i, None if d is None else str(d), r) for i, d, r in want]
    # A plain cast and F.round, which the helpers replace, don't pass.
    plain = df.select("i", F.col("v").try_cast("decimal(30,7)").cast("string"), F.when(finite, F.round("v", 6))).collect()
    assert sum(tuple(a) != tuple(b) for a, b in zip(plain, got)) > 100


def test_growth_by_fund_has_the_digits_of_sql(spark, sf):
    large = Path(sf).parent / "sf0.1"
    if not large.exists():
        pytest.skip("needs deals of short holds, as in sf0.1")
    con = duckdb.connect()
    for f in os.listdir(large):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{large}/{f}'")
    text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    got = registry.QUERIES["R40_growth"](spark, str(large)).select("is_total", "fund", "rev_cagr", "ebitda_cagr").collect()
    assert text(got) == text(con.execute(f"SELECT is_total, fund, rev_cagr, ebitda_cagr FROM ({registry.ORACLE_SQL['R40_growth']})").fetchall())


def test_growth_over_a_day(spark):
    """Short holds grow by 1e15 and more; the product has to be the double times 1e7, not its shortest digits."""
    d = spark.createDataFrame([("F", 361.2345678, 1.4**121.5), ("F", 5.0, 0.1)], "fund string, w double, g double").withColumn("ic_weight", F.col("w").cast("decimal(24,7)"))
    d = d.select("fund", F.lit("Realized").alias("status"), *(x for m in ("rev_cagr", "ebitda_cagr") for x in (F.col("ic_weight").alias(f"{m}_w"), D._product(F.col("ic_weight"), F.col("g")).alias(f"{m}_p"))))
    row = R.operating_by_fund(d, "growth").where("is_total = 1").first()
    units = int(361.2345678 * 1.4**121.5 * 1e7) + 5_000_000
    assert row.rev_cagr == row.ebitda_cagr == round(float(units / 10**7) / 366.2345678 * 1e6) / 1e6
