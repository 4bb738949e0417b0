"""Incremental ingest of published snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import snapshots as A
from ..operators.store import KEYS, LOG, SnapshotStore

c = F.col


def _newer(rows: DataFrame, store: SnapshotStore) -> DataFrame:
    """Rows of keys whose publication is at least as new as what the store holds; told by the log, without old rows."""
    at = F.coalesce(F.max("published_at"), F.lit("0001-01-01").cast("timestamp"))
    come, had = rows.groupBy(*KEYS).agg(at.alias("come")), store.current().groupBy(*KEYS).agg(at.alias("had"))  # a row a snapshot
    stay = come.join(had, KEYS).where("had > come").select(*KEYS)
    return rows.join(stay, KEYS, "left_anti").select(*rows.columns)


def ingest(spark: SparkSession, incoming: str, folder: str, checkpoint: str, schema: StructType, per_batch: int = 1000):
    """Picks up new snapshot files from incoming and keeps the newest publication of each key in the store at folder.

    Idempotent: a micro-batch is a publication under its own number, so a replayed one changes nothing, and an older
    publication never replaces a newer one. Where a key's newest publication in the batch is at least as new as that
    in the store, the batch's rows stand for it, so equal deals of one snapshot all stay. No rows that the store holds
    are read. Ends when all files are read.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        store = SnapshotStore(batch.sparkSession, folder)
        store.publish(_newer(A.newest(A.with_keys(batch), KEYS), store), f"{checkpoint}#{epoch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "at timestamp, v long"
ARRIVALS = "gp_key string, as_of string, v long, publication string, published_at timestamp, status string"


def _judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The status of each publication of a key, in the order of their numbers; the state is the newest one."""
    held = state.get if state.exists else None
    rows = pd.concat(list(batches)).drop_duplicates("v").sort_values("v")
    status = []
    for at, v in zip(rows["published_at"], rows["v"]):
        at = pd.Timestamp(0) if pd.isna(at) else pd.Timestamp(at)
        if held is None:
            status.append("new")
        elif at == pd.Timestamp(held[0]):
            status.append("replay")
        else:
            status.append("newer" if at > pd.Timestamp(held[0]) else "late")
        if status[-1] in ("new", "newer"):
            held = (at.to_pydatetime(), int(v))
    state.update(held)
    out = rows[["gp_key", "as_of", "v", "publication", "published_at"]].copy()
    out["status"] = status
    yield out


def arrivals(spark: SparkSession, source: str) -> DataFrame:
    """A stream of the publications of a store, a row for each key, with what they are to the key's state.

    new: the key's first one; newer: its time is later than that of all before; replay: it has the time of the
    newest one; late: it is older, whether it was published late or arrived out of order. The log is what streams, so
    a publication of any number of deals is a row a key; a publication without a time counts as the oldest.
    """
    log = spark.readStream.schema(LOG).parquet(f"{source.rstrip('/')}/log")
    once = log.select(*KEYS, "v", "publication", F.coalesce("published_at", F.lit("1970-01-01").cast("timestamp")).alias("published_at"))
    return once.groupBy(*KEYS).applyInPandasWithState(_judge, ARRIVALS, STATE, "append", GroupStateTimeout.NoTimeout)


def follow(spark: SparkSession, source: str, folder: str, checkpoint: str):
    """Copies what is new in the store at source to the store at folder, and keeps a table of all arrivals in folder/arrivals.

    Only rows of publications that are new or newer are read, each from its own folder; late ones and replays stay in
    the table of arrivals with their status. A micro-batch that runs again changes nothing. Ends when the log is read.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark_ = batch.sparkSession
        seen = batch.withColumn("epoch", F.lit(epoch))
        where = f"{folder.rstrip('/')}/arrivals/e={epoch}"
        seen.write.mode("overwrite").parquet(where)
        seen = spark_.read.schema(seen.schema).parquet(where)
        last = seen.where(c("status").isin("new", "newer")).groupBy(*KEYS).agg(F.max("v").alias("v"))
        origin = SnapshotStore(spark_, source)
        chosen = origin.log().join(last, [*KEYS, "v"], "left_semi")
        if not chosen.isEmpty():
            store = SnapshotStore(spark_, folder)
            store.publish(_newer(origin.read(chosen), store), f"{checkpoint}#{epoch}")

    return arrivals(spark, source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
