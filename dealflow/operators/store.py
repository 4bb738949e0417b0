"""Snapshots in versions with a log of publications.

A publication writes its rows to a folder of its own, then a table of what it holds (one row for each key, manager and
date, with rows, publisher and time) beside the log, and is committed by one rename of that table into the log, which
fails where its number is taken. Readers go by the log alone: they see all of a publication or nothing, the newest one of
each key, and never one that died halfway. Inventories and the choice of snapshots read the log, no data.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

c = F.col
KEYS = ["gp_key", "as_of"]
LOG = "gp_key string, as_of string, gp_name string, track_record_date date, deals long, published_by string, published_at timestamp, publication string, txn string, fields string, v long"


def with_keys(rows: DataFrame) -> DataFrame:
    """A5: gp_key without characters that paths forbid, and as_of as text."""
    gp = F.trim(F.regexp_replace(F.coalesce("gp_name", F.lit("")), r'[\\/:*?"<>|]', "-"))
    return rows.withColumns({"gp_key": F.when(gp == "", "GP").otherwise(gp), "as_of": F.coalesce(c("track_record_date").cast("string"), F.lit("undated"))})


class SnapshotStore:
    """Published snapshots in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        """Numbers of the committed publications, by the names in the log."""
        log = self._path("log")
        names = [f.getPath().getName() for f in self._files.listStatus(log)] if self._files.exists(log) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def log(self) -> DataFrame:
        """A row for each key, manager and date of each publication; v numbers publications."""
        if not self.versions():
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def current(self) -> DataFrame:
        """The log's rows of each key's newest publication."""
        log = self.log()
        last = log.groupBy(*KEYS).agg(F.max("v").alias("v"))
        return log.join(last, [*KEYS, "v"], "left_semi")

    def inventory(self) -> DataFrame:
        """Deals, publisher and time of each snapshot, from the log alone."""
        snapshots = self.current().groupBy("gp_name", "track_record_date")
        return snapshots.agg(F.sum("deals").alias("deals"), F.max_by("published_by", "published_at").alias("published_by"), F.max("published_at").alias("published_at"))

    def staged(self, rows: DataFrame, txn: str | None = None, gathered: bool = False) -> tuple[str, DataFrame]:
        """The rows written to a folder of their own, seen by nobody yet, and their part of the log.

        They are brought together by their keys, so that a task does not write a file for each key; rows that come
        gathered by them, a few keys a partition, are not shuffled again.
        """
        name = f"p{uuid.uuid4().hex}"  # a letter, so that no name reads as a number
        where = f"{self.folder}/data/publication={name}"
        rows = with_keys(rows)
        (rows if gathered else rows.hint("rebalance", *KEYS)).write.partitionBy(*KEYS).option("compression", "zstd").parquet(where)
        held = self.spark.read.schema(rows.schema).parquet(where).groupBy(*KEYS, "gp_name", "track_record_date")
        held = held.agg(F.count("*").alias("deals"), F.max_by("published_by", "published_at").alias("published_by"), F.max("published_at").alias("published_at"))
        return name, held.withColumns({"publication": F.lit(name), "txn": F.lit(txn).cast("string"), "fields": F.lit(rows.schema.json())})

    def commit(self, name: str, held: DataFrame) -> int | None:
        """Moves a staged publication's table into the log under the next free number; None where it holds nothing."""
        before = f"log/_{name}"
        held.coalesce(1).write.parquet(f"{self.folder}/{before}")
        if self.spark.read.schema(held.schema).parquet(f"{self.folder}/{before}").isEmpty():
            self._files.delete(self._path(before), True)
            return None
        context = self._fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        while True:
            number = max(self.versions(), default=0) + 1
            try:
                context.rename(self._path(before), self._path(f"log/v={number}"), no_overwrite)
                return number
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise

    def publish(self, rows: DataFrame, txn: str | None = None, gathered: bool = False) -> DataFrame:
        """Replaces the snapshots of the rows' keys and no others, all at once; (gp_key, as_of, replaced).

        Rows are computed once. A txn that the log holds already changes nothing and returns what it did. Of two
        publications of a key at the same time the one with the larger number stands. A null manager or date is a key of its own.
        gathered: see staged().
        """
        if txn is not None and not self.log().where(c("txn") == txn).isEmpty():
            number = self.log().where(c("txn") == txn).agg(F.min("v")).first()[0]
        else:
            number = self.commit(*self.staged(rows, txn, gathered))
        log = self.log()
        had = log.where(c("v") < number).select(*KEYS).distinct().withColumn("replaced", F.lit(True))
        return log.where(c("v") == number).select(*KEYS).distinct().join(had, KEYS, "left").withColumn("replaced", F.coalesce("replaced", F.lit(False)))

    def read(self, chosen: DataFrame | None = None) -> DataFrame:
        """The rows of the chosen part of current(), of all snapshots by default; only their folders are read.

        The driver lists one folder a snapshot, as for any partitioned table. Publications of other columns give nulls
        where they lack one.
        """
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        found = (self.current() if chosen is None else chosen).select("publication", *KEYS, "fields").distinct().collect()
        if not found:
            raise ValueError(f"no snapshot in {self.folder}")
        paths = [f"{self.folder}/data/publication={r.publication}/gp_key={escape(r.gp_key)}/as_of={escape(r.as_of)}" for r in found]
        schema = StructType()
        for fields in sorted({r.fields for r in found}):
            for f in StructType.fromJson(json.loads(fields)):
                if f.name not in schema.names:
                    schema.add(f)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*paths).drop("publication")

    def latest(self) -> DataFrame:
        """The rows of each manager's latest as-of date, undated ones where a manager has no other; read from no other snapshot."""
        now = self.current()
        last = now.groupBy("gp_name").agg(F.max("track_record_date").alias("track_record_date"))
        same = lambda d: d["gp_name"].eqNullSafe(last["gp_name"]) & d["track_record_date"].eqNullSafe(last["track_record_date"])
        chosen = now.join(last, same(now), "left_semi")
        rows = self.read(chosen)
        return rows.join(last, same(rows), "left_semi")  # managers whose keys are equal share a folder

    def vacuum(self) -> list[str]:
        """Deletes the data of publications that no key's newest version needs, and returns their names.

        Those under way are deleted, too, so it is for times without a publisher; readers that began before may fail.
        """
        data = self._path("data")
        kept = {r.publication for r in self.current().select("publication").distinct().collect()}
        names = [f.getPath().getName().partition("=")[2] for f in self._files.listStatus(data)] if self._files.exists(data) else []
        gone = sorted(set(names) - kept)
        for n in gone:
            self._files.delete(self._path(f"data/publication={n}"), True)
        return gone
