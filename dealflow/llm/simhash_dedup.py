"""SimHash near-dedup by segment popcounts.

A fingerprint of 64 bits is cut into 32 segments of two bits; its embedding is the vector of their bit counts.
The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so pairs
within 3 bits are within 3 in the embedding. The range join over the embedding uses a grid:

* 32 coordinates in four blocks of eight: within distance 3, at least one block agrees in all its counts;
* in each block's cell, the sum of the other coordinates is a further axis with cells of side 4, wider than
  the distance; a fingerprint stands in its own cell and, as a guest, in the next one.

So two fingerprints within the distance meet in a cell, at least one of them at home. Within a cell, sorted by the
sum of all counts, the Manhattan distance of the embeddings bounds theirs from below, and pairs left are verified
exactly by the bits that differ. Cells above ``CELL`` members are cut into blocks, and each pair of blocks is a group of its own, so no
task holds more than two blocks; each group returns one star for each connected part, never all pairs of a
dense group. Only distinct fingerprints take part, with their least document: exact copies cost one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import components

RADIUS, BLOCKS, CELL = 3, 4, 1024


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """The SimHash of each text: lower-cased A-Z, words in shingles joined by a space, repeats included.

    Fewer words than a shingle: the whole sequence is one; none, or null: zero.
    """
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for first, last, data, off in C.pieces(texts, 1 << 20):
        raw = C.lower_ascii(data).tobytes()
        sizes, hs = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            words = raw[a:b].split()
            n = len(words) - shingle + 1
            if n > 1:
                got = [digest(x, 42) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
            else:
                got = [digest(b" ".join(words), 42)] if words else []
            hs += got
            sizes.append(len(got))
        h = np.array(hs, np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.r_[0, np.cumsum(sizes)]
        for i, n in enumerate(sizes):
            if n:
                ones = bits[at[i] : at[i + 1]].sum(axis=0, dtype=np.int64)
                out[first + i] = bit[2 * ones > n].sum(dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = fingerprints(batch.column(text_col), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(fp)], names=["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(C.lean_batches(run), "id long, fp long")


def counts(fp: np.ndarray) -> np.ndarray:
    """The embedding, 32 counts of 0 to 2, each in a field of two bits."""
    m = np.uint64(0x5555555555555555)
    return (fp & m) + ((fp >> np.uint64(1)) & m)


def unary(fp: np.ndarray) -> np.ndarray:
    """The embedding with each count as that many set bits, so that differing bits of two are their Manhattan distance."""
    m = np.uint64(0x5555555555555555)
    a, b = fp & m, (fp >> np.uint64(1)) & m
    return (a | b) | ((a & b) << np.uint64(1))


def cells(fp: np.ndarray, blocks: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, row, guest) of every cell that a fingerprint stands in."""
    v, width, out = counts(fp), 64 // blocks, []
    mask = np.uint64((1 << width) - 1)
    for j in range(blocks):
        part = (v >> np.uint64(j * width)) & mask
        block = (fp >> np.uint64(j * width)) & mask
        rest = np.bitwise_count(fp ^ (block << np.uint64(j * width))).astype(np.uint64) // np.uint64(radius + 1)
        for guest in (0, 1):
            key = (part << np.uint64(10)) | ((rest + np.uint64(guest)) << np.uint64(3)) | np.uint64(j)
            out.append((key, np.arange(len(fp)), np.full(len(fp), guest, bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of the nodes 0 to n - 1 reaches over the pairs (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _near(fp: np.ndarray, guest: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected part of the pairs within radius of which one is at home; of two blocks only pairs across."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, guest, block = fp[order], guest[order], block[order]
    total, embedded = np.bitwise_count(fp), unary(fp)
    stop = np.searchsorted(total, total + radius, "right")
    across = block.min() != block.max()
    out_a, out_b = [], []
    for i in range(0, len(fp), 256):
        rows = slice(i, min(i + 256, len(fp)))
        far = int(stop[rows].max())
        bound = np.bitwise_count(embedded[rows, None] ^ embedded[None, i:far])
        a, b = np.nonzero(bound <= radius)
        a, b = a + i, b + i
        ok = (a < b) & ~(guest[a] & guest[b])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if across:
            ok &= block[a] != block[b]
        out_a.append(a[ok])
        out_b.append(b[ok])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    root = _roots(a, b, len(fp))
    leaf = np.flatnonzero(root != np.arange(len(fp)))
    return fp[leaf], fp[root[leaf]]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect all pairs within radius and no others."""

    def place(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            key, row, guest = cells(fp, blocks, radius)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64)), pa.array(guest)], names=["cell", "fp", "guest"])

    placed = distinct.select("fp").mapInArrow(place, "cell long, fp long, guest boolean")
    size = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(~F.col("guest")).alias("homes")).where("n > 1 AND homes > 0")
    cut = F.ceil(F.col("n") / cell).cast("int")
    block = F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")
    # A cell of one block keeps one group; otherwise a row goes to the pair of its block with each other, and to its own.
    spread = placed.join(size, "cell").withColumn("cut", cut).withColumn("block", block)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    pair = F.struct("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # Small cells share a group by a hash of the cell; their rows stay apart by the cell.
    spread = spread.select(pair.alias("pair"), "fp", "guest", "block")
    groups = F.when(F.col("pair.j") > 0, F.xxhash64("pair")).otherwise(F.pmod(F.xxhash64("pair"), F.lit(1 << 20)))
    spread = spread.select(groups.alias("g"), "pair.cell", "pair.i", "pair.j", "fp", "guest", "block")

    def solve(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            key = np.stack([np.asarray(held.column(c)).astype(np.int64) for c in ("cell", "i", "j")])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if len(edge):  # the last group may go on in the next batch
                yield from each(held.slice(0, edge[-1]), np.r_[0, edge])
                held = held.slice(edge[-1])
        if held is not None and held.num_rows:
            key = np.stack([np.asarray(held.column(c)).astype(np.int64) for c in ("cell", "i", "j")])
            yield from each(held, np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, held.num_rows])

    def each(rows, cut_):
        fp = np.asarray(rows.column("fp")).view(np.uint64)
        guest, block_ = rows.column("guest").to_numpy(zero_copy_only=False), np.asarray(rows.column("block"))
        a, b = [], []
        for s, e in zip(cut_[:-1], cut_[1:]):
            if e - s > 1:
                x, y = _near(fp[s:e], guest[s:e], block_[s:e], radius)
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    dealt = spread.repartition("g").sortWithinPartitions("cell", "i", "j")
    return dealt.select("cell", "i", "j", "fp", "guest", "block").mapInArrow(C.lean_batches(solve), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs.

    component_id is the least doc_id reachable over fingerprints within radius bits, the own included. Documents
    without words (null or blank) have fingerprint zero and link like any other. A null doc_id gets a row and is
    no least id unless its component has no other. Repeated rows give repeated results, a very long text is read whole,
    an empty table gives an empty result, other columns play no part. blocks=2 halves the keys
    for much larger inputs only where radius is 1; with radius 3, four blocks are needed.
    """
    if blocks <= radius or 64 % blocks:
        raise ValueError("blocks has to exceed radius and to divide 64")
    fp = C.saved(with_fingerprint(docs, id_col, text_col, shingle))
    distinct = C.saved(fp.groupBy("fp").agg(F.min("id").alias("least")))
    comp = components(links(distinct, radius, blocks))
    rooted = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "component").join(best, "component").select("fp", "component_id")
    return fp.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_components() of all documents; see there for nulls, blanks, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
