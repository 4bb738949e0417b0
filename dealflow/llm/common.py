"""What the operators share: shared folders, chunks of documents, and exchanges of packed keys.

Documents are dealt to chunks of about ``CHUNK_BYTES`` of text by a hash of their row; the number of
chunks grows with the input, so that a chunk's size does not. Where an operator has to know which keys
(hashes of windows, n-grams, words) other chunks hold, each chunk sends its *distinct* keys, packed as
one binary row for each bucket of the key space, and each bucket answers each chunk. A key that a third
of all documents share thus costs one entry a chunk, and neither a task nor the driver ever gathers it.
"""

from __future__ import annotations

import functools
import inspect
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 16 << 20
CHUNK = "__chunk"
BUCKET = "__bucket"
#: White space between words: U+0020 and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Stands for a null doc_id, which is larger than every other.
NO_ID = np.iinfo(np.int64).max


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; an own one where it is unset and Spark runs locally."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plain_names(added: tuple[str, ...] = ()):
    """For operators that return the columns of docs: they see them under names of no other meaning, so none clashes.

    added: columns that the operator adds; input columns of these names are replaced.
    """

    def wrap(operator):
        parameters = inspect.signature(operator).parameters
        named = [p for p in ("id_col", "text_col") if p in parameters]

        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **how):
            new = {c: f"in{i}" for i, c in enumerate(docs.columns)}
            at = {p: new[how.pop(p, parameters[p].default)] for p in named}
            out = operator(docs.toDF(*new.values()), *args, **at, **how)
            old = {v: k for k, v in new.items()}
            return out.select(*(F.col(c).alias(old.get(c, c)) for c in out.columns if old.get(c) not in added))

        return run

    return wrap


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with idx, the place within their tree from 0 in order of the given columns, and n, the tree's size.

    Ranges of the sort are tasks, so a tree that holds a third of all rows spreads; places are sums over earlier tasks
    plus the place in the own one. The sorted rows are written once, so that places stay when a lost task runs again.
    """
    rows = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("mono", F.monotonically_increasing_id())
    rows = saved(rows.withColumns({"task": F.shiftright("mono", 33).cast("int")}))
    # One row for each task and tree.
    runs = rows.groupBy(tree, "task").agg(F.count("*").alias("size"), F.min("mono").alias("first"))
    before = Window.partitionBy(tree).orderBy("task")
    runs = runs.withColumns({"before": F.sum("size").over(before) - F.col("size"), "n": F.sum("size").over(Window.partitionBy(tree))})
    runs = runs.select(F.col(tree).alias("t"), F.col("task").alias("k"), "before", "first", "n")
    out = rows.join(runs, F.col(tree).eqNullSafe(F.col("t")) & (F.col("task") == F.col("k")))
    return out.withColumn("idx", F.col("mono") - F.col("first") + F.col("before")).drop("mono", "task", "t", "k", "before", "first")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0


def chunk_count(total_bytes: int, spark: SparkSession, chunk_bytes: int = CHUNK_BYTES) -> int:
    """As many chunks as keep each near chunk_bytes, and no fewer than keep all cores busy, unless the input is tiny."""
    least = min(spark.sparkContext.defaultParallelism, 1 + (total_bytes >> 20))
    return max(least, -(-total_bytes // chunk_bytes))


def chunked(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a chunk number, one chunk a partition: the only shuffle of texts.

    The number of the input's partition takes part, so that rows that repeat id and text spread, too; it is the
    same for a row however often a lost task runs again.
    """
    key = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(n)).cast("int")
    return docs.withColumn(CHUNK, key).repartitionById(n, F.col(CHUNK))


def deal(df: DataFrame, n: int, key: str) -> DataFrame:
    """Rows to n partitions by a number from 0 to n - 1."""
    return df.repartitionById(n, F.col(key))


# ---------------------------------------------------------------- documents in compressed packs


def zipped(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def unzipped(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def packs(docs: DataFrame, n: int, cols: list[str], text_col: str, pack_bytes: int = 1 << 20) -> DataFrame:
    """(chunk, blob): the columns of docs as c0, c1, ... in compressed packs of about pack_bytes, dealt to n chunks.

    The only shuffle of texts, at the size of a compressed file. A pack goes to a chunk by a hash of its bytes and of
    its place in its task, so equal packs spread. Tasks that run again make the same packs as long as docs are read in
    the same order, as from files; other DataFrames are to be written first.
    """
    at = cols.index(text_col)

    def run(batches):
        pid, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            out = []
            for a, b, _, _ in pieces(table.column(at), pack_bytes):
                blob = zipped(table.slice(a, b - a))
                out.append((xxhash.xxh64_intdigest(blob, (pid << 24) + k) % n, blob))
                k += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=[CHUNK, "blob"])

    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)))
    return deal(named.mapInArrow(run, f"{CHUNK} int, blob binary"), n, CHUNK)


def unpacked_docs(rows: pa.Table) -> pa.Table:
    """The documents of a chunk's packs."""
    return pa.concat_tables([unzipped(b.as_py()) for b in rows["blob"]]).combine_chunks()


# ---------------------------------------------------------------- texts as flat arrays


def pieces(texts: pa.Array, most: int = 1 << 20):
    """(first, last + 1, bytes, offsets) of runs of rows that hold about ``most`` bytes; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_bounds(data: np.ndarray, off: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the number of words before it."""
    ink = ~spaces[data]
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    inner = off[(off > 0) & (off < len(data))]
    start[inner] = ink[inner]
    end[inner - 1] = ink[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP: dict[int, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and their inverses."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _UP:
        _UP.clear()
        _UP[size] = _powers(int(_ODD), size), _powers(pow(int(_ODD), -1, 2**64), size)
    return _UP[size]


_OTHER_TABLE = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**64, 256, np.uint64) | np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each word from prefix sums of a polynomial in its bytes; other: a second one of other numbers."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_OTHER_TABLE if other else _TABLE)[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive numbers, by doubling; windows that leave a document are the caller's to mask."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, whole, power, width = None, 0, len(h) - n + 1, h, 1
    while True:
        if n & width:
            part = power[have : have + whole]
            out = part if out is None else mix(out * _ODD + part)
            have += width
        if have == n:
            return np.ascontiguousarray(out)
        power = mix(power[: len(power) - width] * _ODD + power[width:])
        width *= 2


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """For each unit the document that holds it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ids(table: pa.Table, col: str) -> np.ndarray:
    return np.asarray(table[col].combine_chunks().cast(pa.int64()).fill_null(NO_ID))


# ---------------------------------------------------------------- packed keys


def group_min(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and the least and largest value of each."""
    if not len(keys):
        return keys, values, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)


def edges(n_buckets: int, bits: int = 64) -> np.ndarray:
    """The least 64-bit key of each bucket but the first; keys that agree in their first bits share a bucket.

    Buckets are ranges of even width; with fewer than 64 bits there are at most 2 ** bits of them.
    """
    n_buckets = min(n_buckets, 1 << min(bits, 32))
    if n_buckets < 2:
        return np.zeros(0, np.uint64)
    step, rest = divmod(1 << bits, n_buckets)
    b = np.arange(1, n_buckets, dtype=np.uint64)
    return (b * np.uint64(step) + (b * np.uint64(rest) + np.uint64(n_buckets - 1)) // np.uint64(n_buckets)) << np.uint64(64 - bits)


def packed(chunk: int, n_buckets: int, keys: np.ndarray, *cols: np.ndarray, bits: int = 64) -> pa.Table:
    """Rows (bucket, chunk, keys, *cols) of sorted keys; a bucket is a range of the 64-bit key space."""
    cut = np.r_[0, np.searchsorted(keys, edges(n_buckets, bits)), len(keys)]
    full = np.flatnonzero(np.diff(cut))
    names = ["keys", *(f"c{i}" for i in range(len(cols)))]
    return pa.table(
        {BUCKET: pa.array(full, pa.int32()), CHUNK: pa.array(np.full(len(full), chunk), pa.int32())}
        | {n: pa.array([c[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()) for n, c in zip(names, (keys, *cols), strict=True)}
    )


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeezed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys and 32-bit counts in few bytes: gaps between keys, byte by byte, compressed."""
    flat = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(keys).to_bytes(4, "little") + _ZSTD.compress(flat, asbytes=True)


def unsqueezed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    flat = np.frombuffer(_ZSTD.decompress(blob[4:], 12 * n, asbytes=True), np.uint8)
    keys = np.ascontiguousarray(flat[: 8 * n].reshape(8, n).T).view(np.uint64).reshape(-1)
    return np.cumsum(keys), np.ascontiguousarray(flat[8 * n :].reshape(4, n).T).view(np.uint32).reshape(-1)


def squeezed_bits(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(4, "little") + _ZSTD.compress(np.packbits(bits).tobytes(), asbytes=True)


def unsqueezed_bits(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return np.unpackbits(np.frombuffer(_ZSTD.decompress(blob[4:], -(-n // 8), asbytes=True), np.uint8), count=n).astype(bool)


def unpacked(table: pa.Table, col: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and the row of each."""
    blobs = table[col].to_pylist()
    out = np.frombuffer(b"".join(blobs), kind)
    size = np.dtype(kind).itemsize
    return out, np.repeat(np.arange(len(blobs)), [len(b) // size for b in blobs])


def flat(table: pa.Table, col: str, kind) -> np.ndarray:
    """All values of a packed column."""
    return np.frombuffer(b"".join(table[col].to_pylist()), kind)


def found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among sorted distinct ones, and whether it does."""
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def shared_keys(request: DataFrame, n_buckets: int) -> DataFrame:
    """(chunk, keys): of each chunk's keys those that documents of another chunk hold too, or several of its own.

    request: (bucket, chunk, keys, c0), c0 a byte that is 1 where the chunk's own documents share the key.
    """

    def answer(rows: pa.Table) -> pa.Table:
        keys, row = unpacked(rows, "keys", np.uint64)
        own, _ = unpacked(rows, "c0", np.uint8)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(k)])
        many = np.repeat((size > 1) | (np.maximum.reduceat(own[order], first) > 0 if len(k) else size > 1), size)
        hit = np.zeros(len(keys), bool)
        hit[order] = many
        chunks = rows[CHUNK].to_pylist()
        cut = np.r_[0, np.cumsum(np.bincount(row, minlength=len(chunks)))]
        out = [(c, keys[a:b][hit[a:b]].tobytes()) for c, a, b in zip(chunks, cut, cut[1:]) if hit[a:b].any()]
        return pa.table({CHUNK: pa.array([c for c, _ in out], pa.int32()), "keys": pa.array([k for _, k in out], pa.binary())})

    return deal(request, n_buckets, BUCKET).groupBy(BUCKET).applyInArrow(lean(answer), f"{CHUNK} int, keys binary")


def least_of(keys: np.ndarray, others: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry the least value among those that agree with it in both keys; and the order and starts of the groups."""
    order = np.lexsort((others, keys))
    k, o = keys[order], others[order]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]) if len(k) else np.zeros(0, np.int64)
    out = values.copy()
    if len(k):
        out[order] = np.repeat(np.minimum.reduceat(values[order], first), np.diff(np.r_[first, len(k)]))
    return out, order, first


def least_docs(request: DataFrame, n_buckets: int, wide: bool = False) -> DataFrame:
    """(chunk, keys, docs): for each chunk's keys the least document that holds them, where another chunk has it.

    request: (bucket, chunk, keys, c0), c0 the least document of the chunk as int64. wide: c1 holds a second 64-bit hash
    of each key's text, which has to agree, too; it is answered as others.
    """

    def answer(rows: pa.Table) -> pa.Table:
        keys, row = unpacked(rows, "keys", np.uint64)
        docs, _ = unpacked(rows, "c0", np.int64)
        others = flat(rows, "c1", np.uint64) if wide else np.zeros(len(keys), np.uint64)
        best, _, _ = least_of(keys, others, docs)
        hit = best < docs
        chunks = rows[CHUNK].to_pylist()
        cut = np.r_[0, np.cumsum(np.bincount(row, minlength=len(chunks)))]
        spans = [(c, a, b) for c, a, b in zip(chunks, cut, cut[1:]) if hit[a:b].any()]
        cols = {"keys": keys, "docs": best} | ({"others": others} if wide else {})
        return pa.table({CHUNK: pa.array([c for c, _, _ in spans], pa.int32())} | {name: pa.array([x[a:b][hit[a:b]].tobytes() for _, a, b in spans], pa.binary()) for name, x in cols.items()})

    return deal(request, n_buckets, BUCKET).groupBy(BUCKET).applyInArrow(lean(answer), f"{CHUNK} int, keys binary, docs binary" + ", others binary" * wide)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other letters stay."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


# ---------------------------------------------------------------- memory of Python workers


def _released(result):
    """Hands freed memory back to the system, so that idle workers stay small beside the executor's heap."""
    import ctypes

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    return result


def lean(group):
    """A function of one group that leaves no freed memory behind."""
    return lambda rows: _released(group(rows))


def lean_pair(group):
    """The same for cogroups."""
    return lambda rows, other: _released(group(rows, other))


def lean_batches(run):
    """The same for functions over all batches of a task."""

    def all_batches(batches):
        yield from run(batches)
        _released(None)

    return all_batches
