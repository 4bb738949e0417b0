"""Benchmark decontamination by MinHash containment, partitioned by item size.

An item (test text) is contained in a document where the document holds at least 80 per cent of the item's
distinct shingles of five words. Documents may be thousands of times longer than items, so that a Jaccard
sketch of the document says nothing; the sketch is taken of the item instead. Items are partitioned by their
number of shingles into classes [2^c, 2^(c+1)). Within a class, an item keeps its k least shingle hashes
(bottom-k MinHash), k the number of shingles of the class's largest item that a contained one may miss, plus one: a
document that misses all k misses too many, so one hit at least is certain, and the search loses nothing. Only
hashes up to the class's largest kept one can hit. Candidates are verified by the share of the item's whole
shingle set found in the document, word by word.

Items are a query set: they go to the executors in blocks of at most ``BLOCK_BYTES``, filled in turn as the driver
reads the items, one pass over the documents for each block. A block is written out and released before the next
one is read, so memory is bounded however many items there are and however often one repeats. No text is shuffled.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE, THRESHOLD, BLOCK_BYTES = 5, 0.8, 16 << 20


def _shingles(data, off, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of lower-cased texts, the text of each, and the words of each text."""
    data = C.lower_ascii(data)
    starts, ends, bounds = C.word_bounds(data, off)
    h = C.window_hashes(C.word_hashes(data, starts, ends), n)
    doc = C.doc_of(bounds)[: len(h)]
    ok = np.arange(len(h)) + n <= bounds[doc + 1]
    return h[ok], doc[ok], np.diff(bounds)


def _words(raw: bytes) -> list[bytes]:
    return raw.split()


class Items:
    """The shingle sets of a block of items, and their size-partitioned sketches."""

    def __init__(self, texts: list[str | None], shingle: int, threshold: float):
        self.words = [_words(C.lower_ascii(np.frombuffer((t or "").encode(), np.uint8)).tobytes()) for t in texts]
        self.n = np.array([min(len(w), shingle) for w in self.words], np.int64)
        self.sizes = sorted({n for n in self.n.tolist() if n})
        #: Of each item the first places of its distinct shingles, and their hashes.
        self.places: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        self.hashes: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
        for n in self.sizes:
            at = np.flatnonzero(self.n == n)
            for a, b, data, off in C.pieces(pa.array([texts[i] for i in at], pa.string())):
                h, doc, _ = _shingles(data, off, n)
                edge = np.searchsorted(doc, np.arange(b - a + 1))
                for i in range(b - a):
                    w = self.words[at[a + i]]
                    first: dict[tuple, int] = {}
                    for k in range(len(w) - n + 1):
                        first.setdefault(tuple(w[k : k + n]), k)
                    self.places[at[a + i]] = np.fromiter(first.values(), np.int64, len(first))
                    self.hashes[at[a + i]] = h[edge[i] : edge[i + 1]][self.places[at[a + i]]]
        size = np.array([len(s) for s in self.places], np.int64)
        self.need = np.array([-(-round(threshold * m * 1_000_000) // 1_000_000) for m in size.tolist()], np.int64)
        self.sketch: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in self.sizes:
            keys, items = [], []
            mine = np.flatnonzero((self.n == n) & (size > 0))
            classes = np.floor(np.log2(size[mine])).astype(int) if len(mine) else mine
            for c in np.unique(classes):
                of = mine[classes == c]
                k = int((size[of] - self.need[of]).max()) + 1
                for i in of.tolist():
                    keys.append(np.sort(self.hashes[i])[:k])
                    items.append(np.full(len(keys[-1]), i))
            if keys:
                k, i = np.concatenate(keys), np.concatenate(items)
                order = np.argsort(k, kind="stable")
                k, i = k[order], i[order]
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                self.sketch[n] = k[first], np.r_[first, len(k)], i

    def _shared(self, i: int, words: list[bytes], h: np.ndarray, order: np.ndarray) -> int:
        """Distinct shingles of item i that stand among a document's words; h, order: its shingle hashes, and their order."""
        n, own, in_order = int(self.n[i]), self.words[i], h[order]
        lo, hi = np.searchsorted(in_order, self.hashes[i]), np.searchsorted(in_order, self.hashes[i], "right")
        if (hi > lo).sum() < self.need[i]:
            return 0
        return sum(any(words[p : p + n] == own[k : k + n] for p in order[a:b]) for k, a, b in zip(self.places[i].tolist(), lo.tolist(), hi.tolist()))

    def search(self, texts: pa.Array):
        """(text, item, shared, of) for every item contained in a text."""
        for a, _, data, off in C.pieces(texts):
            for n, (keys, cut, items) in self.sketch.items():
                h, doc, _ = _shingles(data, off, n)
                low = np.flatnonzero(h <= keys[-1])
                at, hit = C.found(h[low], keys)
                at, of = at[hit], doc[low[hit]]
                if not len(at):
                    continue
                pair = np.unique(of * len(keys) + at)
                bounds = np.searchsorted(doc, np.arange(len(off)))
                last = -1
                for p in pair.tolist():
                    d, k = divmod(p, len(keys))
                    if d != last:
                        last, own, seen = d, h[bounds[d] : bounds[d + 1]], set()
                        order = np.argsort(own, kind="stable")
                        words = _words(C.lower_ascii(data[off[d] : off[d + 1]]).tobytes())
                    for i in items[cut[k] : cut[k + 1]].tolist():
                        if i not in seen:
                            seen.add(i)
                            shared = self._shared(i, words, own, order)
                            if shared >= self.need[i]:
                                yield a + d, i, shared, len(self.places[i])


def _blocks(items: DataFrame, block_bytes: int):
    """Lists of (item, text) of at most block_bytes of text, or of one longer item."""
    n = 1 + C.text_bytes(items) // block_bytes
    held, size = [], 0
    for r in items.repartition(n).toLocalIterator():  # a partition of about one block at a time
        more = len((r["text"] or "").encode())
        if held and size + more > block_bytes:
            yield held
            held, size = [], 0
        held.append((r["item"], r["text"]))
        size += more
    yield held


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): every pair of a document and an item that it contains.

    Words are lower-cased in A-Z. An item of fewer than five words is one shingle of all its words; one without
    words, or null, is in no document. A null text contains nothing. Repeated rows of either side give repeated
    pairs, null ids are ids like any other, and a very long text is searched whole by one task. Other columns of either
    side play no part. Empty tables on either side give an empty result. More than one block of items: each block's
    pairs are written to the shared folder.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    path, written, blocks = C.shared_path(spark, "contained"), False, _blocks(items, block_bytes)
    block = next(blocks)
    for following in chain(blocks, [None]):
        held = spark.sparkContext.broadcast(block)
        found = texts.mapInArrow(C.lean_batches(_searcher(held, shingle, threshold)), PAIRS)
        if written or following is not None:
            found.write.mode("append").parquet(path)
            held.destroy()
            written = True
        block = following
    found = spark.read.schema(PAIRS).parquet(path) if written else found
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


PAIRS = "doc_id long, item_id long, n_shared long, n_item long"


def _searcher(held, shingle, threshold):
    def run(batches):
        ids = [i for i, _ in held.value]
        block = Items([t for _, t in held.value], shingle, threshold)
        for batch in batches:
            got = list(block.search(batch.column(1)))
            docs = batch.column(0).take(pa.array([d for d, *_ in got], pa.int64()))
            item = pa.array([ids[i] for _, i, *_ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([docs, item, pa.array([s for *_, s, _ in got], pa.int64()), pa.array([n for *_, n in got], pa.int64())], names=["doc_id", "item_id", "n_shared", "n_item"])

    return run


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text contains an item.

    Each row is judged by its own text where it lies, so nothing is shuffled or joined; other texts of the same or of a
    null doc_id stay. Null and blank texts contain nothing and stay, as do repeated rows of clean texts; a very long text
    is searched whole by one task; further columns are kept whatever their names. Empty tables give docs as it is.
    More than one block of items: what is left after a block is written to the shared folder for the next one.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    items = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))

    def without(held):
        def run(batches):
            block = Items([t for _, t in held.value], shingle, threshold)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in block.search(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        return C.lean_batches(run)

    for k, block in enumerate(_blocks(items, block_bytes)):
        if k:
            docs = C.saved(docs)
        docs = docs.mapInArrow(without(spark.sparkContext.broadcast(block)), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contained_items() of all documents and benchmark items; see there for nulls, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
i AS (SELECT item_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x:x + n - 1], ' ')))) AS s FROM (SELECT item_id, w, least(len(w), 5) AS n FROM v WHERE len(w) > 0)),
m AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS (SELECT doc_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x:x + n - 1], ' ')))) AS s FROM w, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
SELECT d.doc_id, i.item_id, count(*) AS n_shared, any_value(m.n_item) AS n_item, count(*) / any_value(m.n_item)::DOUBLE AS containment
FROM d JOIN i ON d.s = i.s AND d.n = i.n JOIN m ON m.item_id = i.item_id
GROUP BY d.doc_id, i.item_id HAVING count(*) >= 0.8 * any_value(m.n_item)
"""
