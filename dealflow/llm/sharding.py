"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

The ring has 65,536 places. Each shard owns ``vnodes`` of them, its virtual nodes; a key falls on the place of its
hash and belongs to the next virtual node clockwise. Every shard has a capacity. Keys are taken in the order of
their place, hash, id, size and text CRC, and one whose shard is full goes on clockwise to the next virtual
node of a shard that is not: so no shard exceeds its capacity, and only overflowing keys leave their place.

That walk needs the number of keys of each arc only, a table of at most ``shards * vnodes`` rows. The driver
walks over it and gets, for each arc, runs of ranks within the arc and the shard and first slot of each run; the
rows then find their run by their rank. Ranks come from one sort by ranges of that order; rows that agree in all of it
are told apart by where they were read, so equal rows spread over tasks, and which of them takes which slot is the
one thing that depends on it. No text is shuffled; the other columns are written once, so that each row keeps its
rank when a lost task runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

PLACES = 1 << 16
SHARDS, VNODES = 40, 64


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(place, arc, owner): for each place the virtual node that keys on it belong to; arcs count clockwise from 0."""
    node = spark.range(0, shards * vnodes, 1, 1).select((F.col("id") % shards).cast("int").alias("owner"), F.shiftrightunsigned(F.xxhash64(F.lit("node"), F.col("id") % shards, (F.col("id") / shards).cast("int")), 48).alias("at"))
    node = node.groupBy("at").agg(F.min("owner").alias("owner"))
    w = Window.orderBy("at")
    node = node.select("owner", "at", (F.row_number().over(w) - 1).alias("arc"), F.lag("at", 1, -1).over(w).alias("before"))
    last = F.max("at").over(Window.partitionBy())
    wrap = node.withColumn("last", last).where("arc = 0 AND last < 65535").select("owner", "arc", F.explode(F.sequence(F.col("last") + 1, F.lit(PLACES - 1).cast("long"))).alias("place"))
    own = node.select("owner", "arc", F.explode(F.sequence((F.col("before") + 1).cast("long"), F.col("at").cast("long"))).alias("place"))
    return own.union(wrap).select(F.col("place").cast("int").alias("place"), "arc", "owner")


def walk(owner: list[int], keys: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, last rank + 1, shard, first slot) of keys taken arc by arc, under the shards' capacities."""
    load, out, n = [0] * len(capacity), [], len(owner)
    after = list(range(n + 1))  # next arc whose shard may have room, n stands for going round

    def free(i):
        path = []
        while i < n and (after[i] != i or load[owner[i]] >= capacity[owner[i]]):
            path.append(i)
            i = after[i] if after[i] != i else i + 1
        for p in path:
            after[p] = i
        return i

    for arc in range(n):
        rank = 0
        while rank < keys[arc]:
            at = free(arc)
            if at == n:
                at = free(0)
            shard = owner[at]
            take = min(keys[arc] - rank, capacity[shard] - load[shard])
            out.append((arc, rank, rank + take, shard, load[shard]))
            load[shard] += take
            rank += take
    return out


@C.plain_names(("size", "text_crc32", "shard", "slot"))
def bounded_ring(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without text, with size, text_crc32, shard and slot.

    Capacities are the mean number of rows times 1 + slack, rounded so that they differ by one at most; without
    slack all shards fill, and counts are at most one apart. size: UTF-8 bytes of the text (null: none) plus 16.
    slot is gapless from 0 in every shard. A null doc_id is a key like any other; rows of one id stand next to each
    other in order of size and CRC, and may part where a shard is full. The same rows get the same shards and slots
    however they lie in files. A very long text counts like any other. An empty table gives an empty result; further
    columns are kept, but for ones named like an added column, which are replaced.
    """
    spark = docs.sparkSession
    rows = docs.select(
        *(c for c in docs.columns if c != text_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit("key"), F.col(id_col)).alias("__hash"),
        F.lit(0).alias("__all"),
        F.xxhash64(F.monotonically_increasing_id()).alias("__row"),
    ).withColumn("__place", F.shiftrightunsigned("__hash", 48).cast("int"))
    rows = C.ranked(rows, "__all", ["__place", "__hash", id_col, "size", "text_crc32", "__row"])
    places = ring(spark, shards, vnodes)
    keys = rows.groupBy("__place").agg(F.count("*").alias("count"))
    # A row for each place of the ring: where its keys begin among all, and among those of its arc.
    at = places.join(keys, places["place"] == keys["__place"], "left").select("place", "arc", "owner", F.coalesce("count", F.lit(0)).alias("count"))
    begin = lambda w: F.sum("count").over(w) - F.col("count")
    at = C.saved(at.withColumns({"begin": begin(Window.orderBy("place")), "before": begin(Window.partitionBy("arc").orderBy("place"))}))
    # At most shards * vnodes rows: the arcs, with their keys.
    arcs = at.groupBy("arc").agg(F.first("owner").alias("owner"), F.sum("count").alias("keys")).orderBy("arc").collect()
    total = sum(r["keys"] for r in arcs)
    room = max(total, -(-int(total * (1 + slack) * 1_000_000) // 1_000_000))
    capacity = [room // shards + (s < room % shards) for s in range(shards)]
    runs = walk([r["owner"] for r in arcs], [r["keys"] for r in arcs], capacity)
    table = spark.createDataFrame(runs, "arc int, first long, end long, shard int, base long")
    table = table.groupBy(F.col("arc").alias("__arc")).agg(F.sort_array(F.collect_list(F.struct("first", "end", "shard", "base"))).alias("__runs"))
    # Both tables are bounded by the ring, whatever the input.
    rows = rows.join(F.broadcast(at.select(F.col("place").alias("__place"), F.col("arc").alias("__arc"), (F.col("before") - F.col("begin")).alias("__shift"))), "__place")
    rows = rows.withColumn("__rank", F.col("idx") + F.col("__shift")).join(F.broadcast(table), "__arc")
    run = F.filter("__runs", lambda r: (r["first"] <= F.col("__rank")) & (F.col("__rank") < r["end"]))[0]
    rows = rows.withColumn("__run", run)
    return rows.select(*(c for c in docs.columns if c != text_col), "size", "text_crc32", F.col("__run.shard").alias("shard"), (F.col("__run.base") + F.col("__rank") - F.col("__run.first")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bounded_ring() of all documents under the law rows; see there for nulls, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = bounded_ring(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
