"""Substring dedup on words, with difference-cover anchors.

A passage counts as repeated where 50 consecutive words of a document (a window) also start in a document
with a smaller doc_id; every word that such a window covers goes. Hashing all windows would shuffle one
key a word. A difference cover D of the period 31 holds six residues whose differences are all residues:
for any two positions i and j there is a shift below 31 that brings both to positions in D. So two equal
windows of 50 words hold, at the same place within both, an equal run of 20 words that starts at a
position in D in either document. Steps:

1. each chunk of documents hashes 20-word anchors at cover positions only (six words in 31) and sends its
   distinct hashes to buckets of the hash space; the buckets answer which anchors several documents hold;
2. around shared anchors, the chunk extends to the 50-word windows that contain one, and sends their
   distinct hashes with its least document; buckets answer with a smaller document from elsewhere;
3. the chunk marks covered words and cuts them.

Nothing lists pairs: a passage that a third of all documents share costs one key a chunk. Anchors only select, by
64 bits; windows are equal where two hashes of 64 bits agree that stem from different hashes of their words.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

WINDOW = 50
#: Word and window hashes take several times the bytes of a chunk.
CHUNK_BYTES = 8 << 20
#: A perfect difference set modulo 31: each residue but 0 is one difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def _anchors(data, off, window: int, period: int, cover) -> tuple:
    """Word hashes, bounds, and positions and hashes of the anchors inside documents that have a window."""
    starts, ends, bounds = C.word_bounds(data, off)
    h = C.word_hashes(data, starts, ends)
    length = window - period + 1
    a = C.window_hashes(h, length)
    doc = C.doc_of(bounds)[: len(a)]
    at = np.arange(len(a)) - bounds[doc]
    size = np.diff(bounds)[doc]
    ok = np.isin(at % period, cover) & (at + length <= size) & (size >= window)
    pos = np.flatnonzero(ok)
    return h, bounds, pos, a[pos]


@C.plain_names(("n_words", "n_removed", "kept_sha256", "removed_spans"))
def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover=COVER, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """docs with the repeated words of every text cut out.

    Returns all columns of docs; text_col holds the kept words joined by one space where words were cut, and
    the unchanged text elsewhere. Added (an input column of that name is replaced): n_words, n_removed (long),
    kept_sha256 (of the kept words joined by one space), removed_spans (array of first word, end word).
    A null text has no words and stays null. A null doc_id counts as larger than every other, so such a row
    never makes another lose words, and equal ids never do it to each other. Repeated rows stay, each with the same
    result. A very long text is one row of one task. Empty tables give empty results. chunks: the number of chunks,
    by default from the size of the input; it changes no result.
    """
    spark = docs.sparkSession
    names = docs.columns
    n = chunks or C.chunk_count(C.text_bytes(docs, text_col), spark, CHUNK_BYTES)
    x = C.chunked(docs, n, id_col, text_col)
    cover = np.array(sorted(cover))

    def anchors(rows: pa.Table) -> pa.Table:
        doc_ids, keys, docs_ = C.ids(rows, id_col), [], []
        for a, b, data, off in C.pieces(rows[text_col]):
            _, bounds, pos, key = _anchors(data, off, window, period, cover)
            keys.append(key)
            docs_.append(doc_ids[a:b][C.doc_of(bounds)[pos]])
        k, low, high = C.group_min(np.concatenate(keys), np.concatenate(docs_))
        return C.packed(rows[C.CHUNK][0].as_py(), n, k, (low < high).astype(np.uint8))

    def windows(rows: pa.Table, shared: pa.Table) -> pa.Table:
        if not rows.num_rows or not shared.num_rows:
            return C.packed(0, n, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        among = np.unique(C.unpacked(shared, "keys", np.uint64)[0])
        doc_ids, keys, others, docs_ = C.ids(rows, id_col), [], [], []
        for a, b, data, off in C.pieces(rows[text_col]):
            h, bounds, pos, key = _anchors(data, off, window, period, cover)
            pos = pos[C.found(key, among)[1]]
            at = _near(pos, bounds, window, period)
            if len(at):
                keys.append(C.window_hashes(h, window)[at])
                others.append(_other_hashes(data, off, window)[at])
                docs_.append(doc_ids[a:b][C.doc_of(bounds)[at]])
        if not keys:
            return C.packed(0, n, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        k, o = np.concatenate(keys), np.concatenate(others)
        low, order, first = C.least_of(k, o, np.concatenate(docs_))
        one = order[first]
        return C.packed(rows[C.CHUNK][0].as_py(), n, k[one], low[one], o[one])

    def cut(rows: pa.Table, answer: pa.Table) -> pa.Table:
        out = {c: rows[c] for c in names}
        doc_ids = C.ids(rows, id_col)
        far, far_other, far_doc = C.flat(answer, "keys", np.uint64), C.flat(answer, "others", np.uint64), C.flat(answer, "docs", np.int64)
        parts, keys, others, docs_ = [], [], [], []
        for a, b, data, off in C.pieces(rows[text_col]):
            starts, ends, bounds = C.word_bounds(data, off)
            w = C.window_hashes(C.word_hashes(data, starts, ends), window)
            doc = C.doc_of(bounds)[: len(w)]
            at = np.flatnonzero(np.arange(len(w)) + window <= bounds[doc + 1])
            parts.append((a, b, bounds, at))
            keys.append(w[at])
            others.append(_other_hashes(data, off, window)[at])
            docs_.append(doc_ids[a:b][doc[at]])
        none = np.zeros(0, np.uint64)
        doc = np.concatenate([*docs_, np.zeros(0, np.int64)])
        # The answers take part as windows of their documents.
        least, _, _ = C.least_of(np.concatenate([*keys, none, far]), np.concatenate([*others, none, far_other]), np.r_[doc, far_doc])
        lose = least[: len(doc)] < doc
        texts = rows[text_col].to_pylist()
        kept_text, n_words, n_removed, digest, spans = [], [], [], [], []
        seen = 0
        for a, b, bounds, at in parts:
            bad = at[lose[seen : seen + len(at)]]
            seen += len(at)
            edge = np.zeros(bounds[-1] + 1, np.int64)
            np.add.at(edge, bad, 1)
            np.add.at(edge, bad + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            count = np.r_[0, np.cumsum(gone)]
            removed = count[bounds[1:]] - count[bounds[:-1]]
            for i in range(b - a):
                text = texts[a + i]
                words = (text or "").encode().split()
                if removed[i]:
                    g = gone[bounds[i] : bounds[i + 1]]
                    words = list(compress(words, ~g))
                    step = np.flatnonzero(np.diff(np.r_[0, g.astype(np.int8), 0]))
                    spans.append([{"first": int(s), "end": int(e)} for s, e in zip(step[::2], step[1::2])])
                else:
                    spans.append([])
                joined = b" ".join(words)
                kept_text.append(joined.decode() if removed[i] else text)
                digest.append(hashlib.sha256(joined).hexdigest())
            n_words += np.diff(bounds).tolist()
            n_removed += removed.tolist()
        out[text_col] = pa.array(kept_text, pa.string())
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        out["removed_spans"] = pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
        return pa.table(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    blob = f"{C.BUCKET} int, {C.CHUNK} int, keys binary, c0 binary"
    shared = C.shared_keys(x.groupBy(C.CHUNK).applyInArrow(C.lean(anchors), blob), n)
    groups = x.groupBy(C.CHUNK)
    asked = groups.cogroup(C.deal(shared, n, C.CHUNK).groupBy(C.CHUNK)).applyInArrow(C.lean_pair(windows), f"{blob}, c1 binary")
    least = C.deal(C.least_docs(asked, n, wide=True), n, C.CHUNK)
    return groups.cogroup(least.groupBy(C.CHUNK)).applyInArrow(C.lean_pair(cut), f"{schema}, n_words long, n_removed long, kept_sha256 string, removed_spans array<struct<first: long, end: long>>")


def _other_hashes(data: np.ndarray, off: np.ndarray, window: int) -> np.ndarray:
    """A second hash of each window, from other hashes of words."""
    starts, ends, _ = C.word_bounds(data, off)
    return C.window_hashes(C.word_hashes(data, starts, ends, True), window)


def _near(pos: np.ndarray, bounds: np.ndarray, window: int, period: int) -> np.ndarray:
    """Starts of windows inside one document that have one of the anchors at a shift below period."""
    total = int(bounds[-1])
    if not len(pos) or total < window:
        return np.zeros(0, np.int64)
    edge = np.zeros(total + 1, np.int64)
    first = np.maximum(pos - period + 1, bounds[np.searchsorted(bounds, pos, "right") - 1])
    np.add.at(edge, first, 1)
    np.add.at(edge, pos + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    return at[at + window <= bounds[np.searchsorted(bounds, at, "right")]]


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """substring_dedup() of all documents; see there for nulls, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS m FROM p GROUP BY k),
g AS (SELECT DISTINCT p.doc_id, p.i + t.j AS j FROM p JOIN f ON p.k = f.k AND f.m < p.doc_id, range(0, 50) t(j)),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
s AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.j) AS kept FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.j = g.j GROUP BY u.doc_id),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""
