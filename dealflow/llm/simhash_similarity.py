"""Near-dedup by five-word similarity: candidates by MinHash bands and wide SimHash, links by exact Jaccard.

Texts are compared as sets of shingles. Candidates share one of ``BANDS`` bands of ``ROWS`` least hashes whole and
differ in at most ``LOOSE`` of 512 fingerprint bits. At a similarity of 0.8 a pair misses every band with a
probability of (1 - 0.8^5)^20, 0.04 per cent, and the radius with less than 0.02 per cent: it stands at the bits
expected at 0.55, so that also sets of four or five shingles, whose bits differ more than the angle says, stay
inside. Neither decides: the groups that candidates form are only those whose texts are fetched, once each, and
every pair in such a group counts by its exact overlap of shingles (64-bit hashes). So no pair below the limit
links, and of those at the limit fewer than one in a thousand are not found; above it, still fewer.

Cells and groups are cut into blocks, and parts answered as stars, as in simhash_dedup; only distinct shingle sets
take part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components
from .simhash_dedup import _roots

WORDS, SEGMENT, CELL = 8, 16, 512
BANDS, ROWS, LOOSE, BLOCK_BYTES = 20, 5, 128, 4 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def radius_of(similarity: float, bits: int = 64 * WORDS) -> int:
    """Bits that differ at a Jaccard similarity of shingle sets."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingle_hashes(texts: pa.Array, shingle: int = 5):
    """(row, hashes) of each text with words, repeats included; fewer words than a shingle are one shingle."""
    for first, _, data, off in C.pieces(texts, 1 << 20):
        data = C.lower_ascii(data)
        starts, ends, bounds = C.word_bounds(data, off)
        words = C.word_hashes(data, starts, ends)
        long = C.window_hashes(words, shingle)
        for i in range(len(off) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= shingle:
                yield first + i, long[a : b - shingle + 1]
            elif b > a:
                yield first + i, C.window_hashes(words[a:b], int(b - a))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """64 bytes of a list of shingle hashes."""
    salts = C.mix(np.arange(1, WORDS + 1, dtype=np.uint64))
    column = (np.arange(8 * WORDS) * 256).astype(np.int32)
    total = np.zeros((8 * WORDS, 8))
    for s in range(0, len(h), 4096):
        part = C.mix(h[s : s + 4096, None] ^ salts).view(np.uint8)
        total += np.bincount((part + column).ravel(), minlength=256 * 8 * WORDS).astype(np.float32).reshape(-1, 256) @ _BITS
    return np.packbits(2 * total > len(h), axis=1, bitorder="little")[:, 0]


def wide_fingerprints(texts: pa.Array, shingle: int = 5) -> np.ndarray:
    """64 bytes for each text; a text without words gives zeros."""
    out = np.zeros((len(texts), 8 * WORDS), np.uint8)
    for i, h in shingle_hashes(texts, shingle):
        out[i] = wide_fingerprint(h)
    return out


def minhash_bands(h: np.ndarray) -> np.ndarray:
    """A hash of each band of least values of a set of shingle hashes."""
    factors = C.mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(h), 1024):
        np.minimum(least, (factors[:, None] * h[None, s : s + 1024]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _close(fp: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the parts of pairs within radius, as (leaf, root); of two blocks only pairs across are compared."""
    wide = fp.view(np.uint64)
    count = np.bitwise_count(wide).astype(np.int16)
    across = block.min() != block.max()
    out_a, out_b = [], []
    for i in range(0, len(fp), 64):
        rows = slice(i, i + 64)
        low = np.abs(count[rows, None] - count[None, i:]).sum(axis=2)
        a, b = np.nonzero(low <= radius)
        a, b = a + i, b + i
        ok = a < b
        if across:
            ok &= block[a] != block[b]
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64) <= radius
        out_a.append(a[ok])
        out_b.append(b[ok])
    root = _roots(np.concatenate(out_a), np.concatenate(out_b), len(fp))
    leaf = np.flatnonzero(root != np.arange(len(fp)))
    return leaf, root[leaf]


def similar_links(distinct: DataFrame, radius: int, segment: int = SEGMENT, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between nodes of distinct (node, fp) that connect the pairs of a cell within radius."""
    step = segment // 8

    def place(batches):
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
            for j in range(8 * WORDS // step):
                key = np.full(len(fp), j, np.int64)
                for k in range(step):
                    key = key << 8 | fp[:, j * step + k]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node"), batch.column("fp")], names=["cell", "node", "fp"])

    keys = distinct.mapInArrow(place, "cell long, node long, fp binary")
    return _linked(keys, radius, cell)


def candidate_links(distinct: DataFrame, radius: int = LOOSE, cell: int = CELL) -> DataFrame:
    """The same for nodes of distinct (node, fp, bands) that share a band."""
    return _linked(distinct.select(F.explode("bands").alias("cell"), "node", "fp"), radius, cell)


def _linked(keys: DataFrame, radius: int, cell: int) -> DataFrame:
    """Edges (a, b) that connect the rows (cell, node, fp) of a cell within radius."""
    large = C.saved(keys.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell))
    # Cells of one block meet in one shuffle; only rows of larger cells go on to pairs of blocks.
    keyed = keys.repartition("cell")  # both joins below read this one shuffle
    whole = keyed.join(large.select("cell"), "cell", "left_anti")
    zero = F.lit(0)
    whole = whole.select("cell", zero.alias("i"), zero.alias("j"), zero.alias("block"), "node", "fp").sortWithinPartitions("cell")
    spread = keyed.join(large, "cell").withColumn("cut", F.ceil(F.col("n") / cell).cast("int"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    spread = spread.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "fp")
    dealt = spread.withColumn("g", F.xxhash64("cell", "i", "j")).repartition("g").sortWithinPartitions("cell", "i", "j").drop("g")

    def each(rows, cut):
        fp = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
        node, block = np.asarray(rows.column("node")), np.asarray(rows.column("block"))
        a, b = [], []
        for s, e in zip(cut[:-1], cut[1:]):
            if e - s > 1:
                x, y = _close(fp[s:e], block[s:e], radius)
                a.append(node[s:e][x])
                b.append(node[s:e][y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    solved = [d.mapInArrow(C.lean_batches(_groupwise(each)), "a long, b long") for d in (whole, dealt)]
    return solved[0].union(solved[1]).distinct()


def _groupwise(each):
    """A function of sorted batches that calls each(rows, cuts) with whole groups of (cell, i, j)."""

    def solve(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            edge = _edges(held)
            if len(edge):  # the last group may go on in the next batch
                yield from each(held.slice(0, edge[-1]), np.r_[0, edge])
                held = held.slice(edge[-1])
        if held is not None and held.num_rows:
            yield from each(held, np.r_[0, _edges(held), held.num_rows])

    return solve


def _edges(rows) -> np.ndarray:
    key = np.stack([np.asarray(rows.column(c)).astype(np.int64) for c in ("cell", "i", "j")])
    return np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1


def _similar(sets: list[np.ndarray], block: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the parts of pairs of sets with that Jaccard similarity; of two blocks only pairs across count."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    owner, values = np.repeat(np.arange(n), size), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    across = block.min() != block.max()
    root = np.arange(n)
    for i in range(n):
        left = root != root[i]
        if across:
            left &= block != block[i]
        # Sizes alone bound the similarity; sets of one part need no further pair.
        left &= np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9
        if not left.any():
            continue
        a, b = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], "right")
        count = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=n)
        ok = left & (both >= similarity * (size + size[i] - both) - 1e-9) & (both > 0)
        if ok.any():
            parts = np.unique(np.r_[root[i], root[ok]])
            root[np.isin(root, parts)] = parts[0]
            if (root == root[0]).all():
                break
    leaf = np.flatnonzero(root != np.arange(n))
    return leaf, root[leaf]


def verified_links(texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Edges (a, b) that connect the pairs with that similarity in a group of texts (cell, cut, node, text), and no others; cut: blocks of the group."""
    spread = texts.withColumn("block", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    spread = spread.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "text")
    dealt = spread.withColumn("g", F.xxhash64("cell", "i", "j")).repartition("g").sortWithinPartitions("cell", "i", "j").drop("g")

    def each(rows, cut):
        node, block = np.asarray(rows.column("node")), np.asarray(rows.column("block"))
        a, b = [], []
        for s, e in zip(cut[:-1], cut[1:]):
            sets = [np.zeros(0, np.uint64)] * int(e - s)
            for k, h in shingle_hashes(rows.column("text").slice(s, e - s), shingle):
                sets[k] = np.unique(h)
            x, y = _similar(sets, block[s:e], similarity)
            a.append(node[s:e][x])
            b.append(node[s:e][y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return dealt.mapInArrow(C.lean_batches(_groupwise(each)), "a long, b long").distinct()


@C.plain_names()
def near_dedup(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without near copies: of each group of similar texts, the row with the least doc_id stays.

    Groups are connected components of pairs whose sets of shingles have that Jaccard similarity; which pairs are
    compared, see above. Texts without words (null or blank) are copies of each other. Rows without doc_id stay only
    where their group has no other. Rows are told apart by doc_id and text, so null and repeated doc_ids keep their
    other texts; of rows that repeat both one stays. Columns of docs are kept as they are. A very long text is read
    whole by one task. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            fp, bands, node = np.zeros((n, 8 * WORDS), np.uint8), np.zeros((n, BANDS), np.uint64), np.zeros(n, np.uint64)
            for i, h in shingle_hashes(batch.column(1), shingle):
                h = np.unique(h)
                fp[i], bands[i], node[i] = wide_fingerprint(h), minhash_bands(h), C.mix(C.mix(h).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(node.view(np.int64)), _binary(fp), lists], names=["id", "k1", "k2", "size", "node", "fp", "bands"])

    # One row of each doc_id and text, in one shuffle by their key, which the joins below share.
    key = {"__k1": F.xxhash64(id_col, text_col), "__k2": F.xxhash64(F.lit(1), text_col, F.lit(2), id_col)}
    once = docs.withColumns(key).dropDuplicates(["__k1", "__k2"])
    marked = docs.select(id_col, text_col, F.col(id_col).cast("long").alias("id"), *(v.alias(k) for k, v in key.items())).mapInArrow(C.lean_batches(run), "id long, k1 long, k2 long, size long, node long, fp binary, bands array<long>")
    # A null doc_id comes last; equal ones are settled by the key.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("least")
    # Sets are told apart by their sum of hashes, 512 bits of fingerprint and 20 bands; each gets a number of its own.
    distinct = C.saved(marked.groupBy("node", "fp", "bands").agg(first, F.max("size").alias("size")))
    distinct = distinct.withColumn("node", F.monotonically_increasing_id())
    comp = components(candidate_links(distinct.select("node", "fp", "bands")))
    members = C.saved(distinct.select("node", "least", "size").join(comp, "node").withColumnRenamed("component", "cell"))
    cuts = members.groupBy("cell").agg(F.ceil(F.sum("size") / block_bytes).cast("int").alias("cut"))
    members = members.join(cuts, "cell").select("cell", "cut", "node", F.col("least.k1").alias("__k1"), F.col("least.k2").alias("__k2"))
    texts = once.select("__k1", "__k2", F.col(text_col).alias("text")).join(members, ["__k1", "__k2"]).select("cell", "cut", "node", "text")
    linked = components(verified_links(texts, similarity, shingle))
    rooted = distinct.select("node", "least").join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("c"))
    keep = rooted.agg(F.min("least").alias("least")).select(F.col("least.k1").alias("__k1"), F.col("least.k2").alias("__k2"))
    return once.join(keep, ["__k1", "__k2"], "left_semi").select(*docs.columns)
