"""Published snapshots (A4 to A8) and analytics across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .medians import medians
from .reports import measured, pooled
from .segments import agree
from .store import SnapshotStore, with_keys  # noqa: F401

c = F.col


def long_table(deals: DataFrame, as_of: str, published_by: str, published_at: str, source: str = "", currency: str | None = None) -> DataFrame:
    """Deals stamped with as-of date, publisher and time; missing currencies filled from the file's."""
    return deals.withColumns(
        {
            "track_record_date": F.lit(as_of).cast("date"),
            "source_file": F.lit(source),
            "published_by": F.lit(published_by),
            "published_at": F.lit(published_at).cast("timestamp"),
            "fund_currency": S.with_default(c("fund_currency"), F.lit(currency)),
        }
    )


def publish(rows: DataFrame, folder: str, txn: str | None = None, gathered: bool = False) -> DataFrame:
    """See SnapshotStore.publish()."""
    return SnapshotStore(rows.sparkSession, folder).publish(rows, txn, gathered)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Deals, publisher and time of each snapshot, without a look at their data."""
    return SnapshotStore(spark, folder).inventory()


def read_snapshots(spark: SparkSession, folder: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """All snapshots of a store as one table, or all files of a plain folder of CSV, which needs a schema."""
    if fmt == "csv":
        return spark.read.schema(schema).csv(folder, header=True)
    return SnapshotStore(spark, folder).read()


def newest(rows: DataFrame, keys: tuple[str, ...] = ("gp_name", "track_record_date")) -> DataFrame:
    """Of each key the rows of its latest publication; a publication without a time is older than every other."""
    last = rows.groupBy(*keys).agg(F.max("published_at").alias("published_at"))  # a row a snapshot
    return rows.join(last, agree(rows, last, [*keys, "published_at"]), "left_semi")


def latest(snapshots: DataFrame) -> DataFrame:
    """The rows of each manager's latest as-of date; undated ones where a manager has no other."""
    last = snapshots.groupBy("gp_name").agg(F.max("track_record_date").alias("track_record_date"))  # a row a manager
    return snapshots.join(last, agree(snapshots, last, ["gp_name", "track_record_date"]), "left_semi")


def over_time(snapshots: DataFrame) -> DataFrame:
    """Pooled statistics by manager and as-of date, and the change of the multiple."""
    out = measured(snapshots).groupBy("gp_name", "track_record_date").agg(*pooled())
    before = F.lag("moic").over(Window.partitionBy("gp_name").orderBy("track_record_date"))
    return out.select("gp_name", "track_record_date", "deals", "ic", "moic", "loss_ratio", F.round(c("moic") - before, 6).alias("moic_change"))


def overview(latest_rows: DataFrame) -> DataFrame:
    """Managers, deals, pooled multiple and median hold."""
    out = latest_rows.agg(F.count_distinct("gp_name").alias("gps"), F.count("*").alias("deals"), F.round(S.divide(F.sum(F.coalesce("total_value", F.lit(0))), F.sum("ic_weight")), 6).alias("moic"))
    hold = medians(latest_rows, [], c("hold_period"), "median_hold").agg(F.round(F.first("median_hold"), 6).alias("median_hold"))
    return out.crossJoin(hold)  # one row each


def by_gp(latest_rows: DataFrame) -> DataFrame:
    """Pooled multiple, loss ratio and distributed share of invested capital by manager."""
    dpi = F.round(S.divide(F.sum("realized"), F.sum("ic_weight")), 6).alias("dpi")
    return measured(latest_rows).groupBy("gp_name").agg(*pooled(), dpi).drop("impaired_ratio")


def deployment(latest_rows: DataFrame) -> DataFrame:
    """Invested capital by manager and vintage."""
    return latest_rows.groupBy("gp_name", "vintage").agg(F.sum("ic_weight").cast("decimal(24,7)").alias("ic"), F.count("*").alias("deals"))


def scatter(latest_rows: DataFrame) -> DataFrame:
    """Multiple against hold by status."""
    return latest_rows.where("gross_moic IS NOT NULL AND hold_period IS NOT NULL").select("deal_id", "status", F.round("gross_moic", 6).alias("moic"), F.round("hold_period", 6).alias("hold"))
