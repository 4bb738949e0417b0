"""Byte-level dedup with suffix arrays over a prefix-free parsing.

A 50-byte string of a document is repeated where it also starts in a document with a smaller doc_id. A suffix
array of the corpus would group equal strings, but sorting every suffix moves each byte's position. A prefix-free
parsing cuts texts at triggers of a rolling hash instead, so that equal text is cut alike, and works on phrases:

1. texts that repeat as a whole are settled by their hash; the least document of each text stands for them;
2. triggers: of the 35 places in each 50-byte string where 16 bytes fit, the one of the least rolling hash. Equal
   strings have the same trigger at the same place, and about one byte in 18 starts a trigger. Chunks send the
   distinct hashes of their triggers to buckets, which answer which ones several texts hold; text between
   triggers that nothing shares cannot repeat and is left out;
3. around shared triggers, a chunk sends the distinct phrases to the trigger's bucket: the 34 bytes before it,
   the 50 bytes from it on, and its least document. The bucket builds two suffix arrays with their LCP arrays:
   one of what starts at the triggers (the parse), one of what ends there, read backwards (the dictionary's phrase
   tails). For each distance of a string's start to its trigger, intervals of the two arrays that agree far
   enough combine into the groups of equal strings, compared byte by byte, and the least document of each;
4. chunks get back which strings are repeated, as bit masks, and cut what they cover.

A passage that a third of all texts share costs one phrase a chunk. No pairs are made, and matches never cross
documents. The order is formed within the buckets of triggers; no order across buckets is needed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH, TRIGGER = 50, 16
PIECE = 256 << 10
#: Phrases and suffix arrays take many times the bytes of a chunk.
CHUNK_BYTES = 8 << 20


def triggers(data: np.ndarray, off: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """(place, hash, document, first, last): each trigger, and the starts of the strings that have it."""
    n, span = len(data), length - width + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none, none
    up, down = C.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(C._TABLE[data] * up[:n], out=sums[1:])
    h = C.mix((sums[width:] - sums[:-width]) * down[: n + 1 - width])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    doc = C.doc_of(off)
    start = np.flatnonzero(off[doc[: len(low)] + 1] >= np.arange(len(low)) + length)
    if not len(start):
        return none, none.astype(np.uint64), none, none, none
    v, d = low[start], doc[start]
    first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (d[1:] != d[:-1])])
    place = (v[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Least hashes crowd at the low end; another mix spreads them over the buckets.
    return place, C.mix(h[place] * C._ODD), d[first], start[first], start[np.r_[first[1:], len(start)] - 1]


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of byte rows, and the common prefix of each with the one before it in that order."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    cols = wide.view(">u8").astype(np.uint64)
    order = np.lexsort(cols.T[::-1])
    s = rows[order]
    differ = np.ones((n, width + 1), bool)
    differ[1:, :width] = s[1:] != s[:-1]
    lcp = differ.argmax(axis=1)
    if n:
        lcp[0] = 0
    return order, lcp


def repeated(rows: np.ndarray, low: np.ndarray, high: np.ndarray, docs: np.ndarray, length: int, width: int) -> np.ndarray:
    """For each phrase a bit for each distance from start to trigger, set where a smaller document has the string.

    rows: the length - width bytes before the trigger and length bytes from it on; low, high: the distances at
    which the phrase has a string.
    """
    before = length - width
    out = np.zeros(len(rows), np.uint64)
    right, right_lcp = _order(rows[:, before:])
    left, left_lcp = _order(rows[:, :before][:, ::-1])
    place_r, place_l = np.empty_like(right), np.empty_like(left)
    place_r[right] = np.arange(len(rows))
    place_l[left] = np.arange(len(rows))
    for o in range(before + 1):
        at = np.flatnonzero((low <= o) & (o <= high))
        if len(at) < 2:
            continue
        r = np.cumsum(right_lcp < length - o)[place_r[at]]
        lf = np.cumsum(left_lcp < o)[place_l[at]] if o else np.zeros(len(at), np.int64)
        key = r.astype(np.uint64) << np.uint64(32) | lf.astype(np.uint64)
        k, least, _ = C.group_min(key, docs[at])
        out[at[least[C.found(key, k)[0]] < docs[at]]] |= np.uint64(1) << np.uint64(o)
    return out


def _in_order(rows: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in an order that does not depend on how they came, their doc_ids, and hashes of their texts in two halves of 64 bits."""
    hashes = np.frombuffer(b"".join([hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in rows[text_col].to_pylist()]), np.uint64).reshape(-1, 2)
    doc_ids = C.ids(rows, id_col)
    order = np.lexsort((hashes[:, 1], hashes[:, 0], doc_ids))
    return rows.take(pa.array(order)), doc_ids[order], hashes[order, 0], hashes[order, 1]


def _new(doc_ids: np.ndarray, hashes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether a document differs in id or text from the one before it in order."""
    if not len(doc_ids):
        return np.zeros(0, bool)
    return np.r_[True, (doc_ids[1:] != doc_ids[:-1]) | (hashes[1:] != hashes[:-1]) | (others[1:] != others[:-1])]


def _stand_in(doc_ids: np.ndarray, hashes: np.ndarray, others: np.ndarray, answer: pa.Table) -> np.ndarray:
    """For each document the least document of the same text; what other chunks answered takes part."""
    far = [C.flat(answer, c, kind) if answer.num_rows else np.zeros(0, kind) for c, kind in (("keys", np.uint64), ("others", np.uint64), ("docs", np.int64))]
    return C.least_of(np.r_[hashes, far[0]], np.r_[others, far[1]], np.r_[doc_ids, far[2]])[0][: len(doc_ids)]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, width: int = TRIGGER, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed_spans, kept): a row for each row of docs.

    kept holds the remaining bytes concatenated (binary: a cut may part a character), removed_spans the maximal
    removed runs. A null text counts as empty. A null doc_id is larger than every other, so such a row never
    makes another lose bytes; rows of equal doc_id do not, either. Other columns play no part. length - width
    must stay below 64. Hashes of triggers have 64 bits and only select; strings are compared whole, but for texts
    that repeat as a whole, which are told by a hash of 128 bits. A very long text is one row of one task. An
    empty table gives an empty result. chunks: the number of chunks, by default from the size of the input; it changes
    no result.
    """
    if not 0 < length - width < 64:
        raise ValueError("length - width has to lie between 1 and 63")
    spark, before = docs.sparkSession, length - width
    docs = docs.select(F.col(id_col), F.col(text_col))
    n = chunks or C.chunk_count(C.text_bytes(docs, text_col), spark, CHUNK_BYTES)
    x = C.chunked(docs, n, id_col, text_col)

    def whole(rows: pa.Table) -> pa.Table:
        _, doc_ids, hashes, others = _in_order(rows, id_col, text_col)
        least, order, first = C.least_of(hashes, others, doc_ids)
        one = order[first]
        return C.packed(rows[C.CHUNK][0].as_py(), n, hashes[one], least[one], others[one])

    def ones(rows: pa.Table, same: pa.Table):
        """The rows that stand for their text, and their numbers in the order of the chunk."""
        rows, doc_ids, hashes, others = _in_order(rows, id_col, text_col)
        mine = np.flatnonzero((_stand_in(doc_ids, hashes, others, same) == doc_ids) & _new(doc_ids, hashes, others))
        return rows[text_col].take(pa.array(mine)), doc_ids[mine], mine

    def ask(rows: pa.Table, same: pa.Table) -> pa.Table:
        texts, doc_ids, _ = ones(rows, same)
        keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b, data, off in C.pieces(texts, PIECE):
            _, h, d, _, _ = triggers(data, off, length, width)
            keys.append(h)
            owner.append(doc_ids[a:b][d])
        k, low, high = C.group_min(np.concatenate(keys), np.concatenate(owner))
        return C.packed(rows[C.CHUNK][0].as_py(), n, k, (low < high).astype(np.uint8))

    def phrases(rows: pa.Table, answers: pa.Table) -> pa.Table:
        own = np.asarray(answers["docs"].is_null()) if answers.num_rows else np.zeros(0, bool)
        shared = np.unique(C.unpacked(answers.filter(pa.array(own)), "keys", np.uint64)[0])
        empty = pa.table({C.BUCKET: pa.array([], pa.int32()), C.CHUNK: pa.array([], pa.int32())} | {c: pa.array([], pa.binary()) for c in ("rows", "range", "docs", "local")})
        if not rows.num_rows or not len(shared):
            return empty
        texts, doc_ids, mine = ones(rows, answers.filter(pa.array(~own)))
        hs, body, reach, owner, number, where = [], [], [], [], [], []
        for a, b, data, off in C.pieces(texts, PIECE):
            place, h, d, first, last = triggers(data, off, length, width)
            hit = C.found(h, shared)[1]
            place, h, d, first, last = (v[hit] for v in (place, h, d, first, last))
            wide = np.zeros(len(data) + before + length, np.uint8)
            wide[before : before + len(data)] = data
            got = wide[place[:, None] + np.arange(before + length)]
            # Bytes of neighbouring documents are not part of the phrase.
            far = place[:, None] - before + np.arange(before + length)
            got[(far < off[d][:, None]) | (far >= off[d + 1][:, None])] = 0
            hs.append(h)
            body.append(got)
            reach.append(np.stack([place - last, place - first], 1).astype(np.uint8))
            owner.append(doc_ids[a:b][d])
            number.append(mine[a:b][d])
            where.append(place - off[d])
        h, body, reach, owner, number, where = map(np.concatenate, (hs, body, reach, owner, number, where))
        # One row for each distinct phrase: in order of trigger, bytes, range and document.
        wide = np.zeros((len(h), -(-(body.shape[1] + 2) // 8) * 8), np.uint8)
        wide[:, : body.shape[1]] = body
        wide[:, body.shape[1] : body.shape[1] + 2] = reach
        cols = wide.view(">u8").astype(np.uint64)
        digest = np.zeros(len(h), np.uint64)
        for c in cols.T:
            digest = C.mix(digest * C._ODD + c)
        order = np.lexsort((owner, digest, h))
        h, body, reach, owner, number, where, cols = (v[order] for v in (h, body, reach, owner, number, where, cols))
        new = np.r_[True, (h[1:] != h[:-1]) | (cols[1:] != cols[:-1]).any(axis=1)] if len(h) else np.zeros(0, bool)
        one = np.flatnonzero(new)
        kind = np.cumsum(new) - 1
        cut = np.r_[0, np.searchsorted(h[one], C.edges(n)), len(one)]
        ends = np.r_[one, len(h)]
        # For each occurrence: its phrase, the document's number and place, and whether a smaller one is here.
        second = owner > owner[one][kind] if len(h) else new
        full = np.flatnonzero(np.diff(cut))
        out = {c: [] for c in ("rows", "range", "docs", "local")}
        for b in full.tolist():
            s, e = cut[b], cut[b + 1]
            p, q = ends[s], ends[e]
            local = np.stack([kind[p:q] - s, number[p:q], where[p:q], second[p:q].astype(np.int64), reach[p:q, 0], reach[p:q, 1]], 0).astype("<u4")
            for c, v in (("rows", body[one[s:e]]), ("range", reach[one[s:e]]), ("docs", owner[one[s:e]]), ("local", local)):
                out[c].append(v.tobytes())
        return pa.table({C.BUCKET: pa.array(full, pa.int32()), C.CHUNK: pa.array(np.full(len(full), rows[C.CHUNK][0].as_py()), pa.int32())} | {c: pa.array(v, pa.binary()) for c, v in out.items()})

    def compare(rows: pa.Table) -> pa.Table:
        body = C.flat(rows, "rows", np.uint8).reshape(-1, before + length)
        reach = C.flat(rows, "range", np.uint8).reshape(-1, 2)
        doc, row = C.unpacked(rows, "docs", np.int64)
        bits = repeated(body, reach[:, 0], reach[:, 1], doc, length, width)
        cut = np.r_[0, np.cumsum(np.bincount(row, minlength=rows.num_rows))]
        places, masks = [], []
        for i, local in enumerate(rows["local"].to_pylist()):
            kind, number, where, second, low, high = np.frombuffer(local, "<u4").reshape(6, -1)
            all_ = ((np.uint64(2) << (high - low).astype(np.uint64)) - np.uint64(1)) << low.astype(np.uint64)
            mask = np.where(second > 0, all_, bits[cut[i] : cut[i + 1]][kind])
            hit = mask > 0
            places.append(np.stack([number[hit], where[hit]], 0).tobytes())
            masks.append(mask[hit].tobytes())
        return pa.table({C.CHUNK: rows[C.CHUNK], "keys": pa.array(places, pa.binary()), "docs": pa.array(masks, pa.binary()), "kind": pa.array(np.ones(rows.num_rows, np.int32))})

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = np.asarray(answers["kind"]) if answers.num_rows else np.zeros(0, np.int32)
        rows, doc_ids, hashes, others = _in_order(rows, id_col, text_col)
        same = _stand_in(doc_ids, hashes, others, answers.filter(pa.array(kinds == 0)))
        first = _new(doc_ids, hashes, others)
        stands = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))  # repeated rows share one number
        number, where, mask = [], [], []
        for k, m in zip(*(answers.filter(pa.array(kinds == 1))[c].to_pylist() for c in ("keys", "docs"))):
            a = np.frombuffer(k, "<u4").reshape(2, -1)
            number.append(a[0])
            where.append(a[1])
            mask.append(np.frombuffer(m, np.uint64))
        number, where, mask = (np.concatenate(v or [np.zeros(0, np.uint64)]) for v in (number, where, mask))
        order = np.argsort(number, kind="stable")
        number, where, mask = number[order].astype(np.int64), where[order].astype(np.int64), mask[order]
        lo, hi = np.searchsorted(number, stands), np.searchsorted(number, stands, "right")
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans", "kept")}
        for i, text in enumerate(rows[text_col].to_pylist()):
            raw = (text or "").encode()
            spans = []
            if same[i] < doc_ids[i]:
                spans = [(0, len(raw))] if len(raw) >= length else []
            elif lo[i] < hi[i]:
                edge = np.zeros(len(raw) + 1, np.int32)
                at, m = where[lo[i] : hi[i]], mask[lo[i] : hi[i]]
                for o in range(before + 1):
                    s = at[(m >> np.uint64(o)) & np.uint64(1) > 0] - o
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + length, -1)
                step = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(edge) > 0).astype(np.int8)])).tolist()
                spans = list(zip(step[::2], step[1::2]))
            kept, last = [], 0
            for s, e in spans:
                kept.append(raw[last:s])
                last = e
            kept = b"".join(kept) + raw[last:]
            for c, v in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"first": s, "end": e} for s, e in spans], kept)):
                out[c].append(v)
        kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table({id_col: rows[id_col]} | {c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds_)})

    blob = f"{C.BUCKET} int, {C.CHUNK} int, keys binary, c0 binary"
    groups = x.groupBy(C.CHUNK)
    same = C.least_docs(groups.applyInArrow(C.lean(whole), f"{blob}, c1 binary"), n, wide=True)
    same_ = C.deal(same, n, C.CHUNK)
    shared = C.shared_keys(groups.cogroup(same_.groupBy(C.CHUNK)).applyInArrow(C.lean_pair(ask), blob), n)
    none = F.lit(None).cast("binary")
    both = same.select(C.CHUNK, "keys", "docs", "others").union(shared.select(C.CHUNK, "keys", none.alias("docs"), none.alias("others")))
    asked = groups.cogroup(C.deal(both, n, C.CHUNK).groupBy(C.CHUNK)).applyInArrow(C.lean_pair(phrases), f"{C.BUCKET} int, {C.CHUNK} int, rows binary, range binary, docs binary, local binary")
    told = C.deal(asked, n, C.BUCKET).groupBy(C.BUCKET).applyInArrow(C.lean(compare), f"{C.CHUNK} int, keys binary, docs binary, kind int")
    last = same.select(C.CHUNK, "keys", "docs", "others", F.lit(0).alias("kind")).union(told.select(C.CHUNK, "keys", "docs", none.alias("others"), "kind"))
    kind = docs.schema[id_col].dataType.simpleString()
    return groups.cogroup(C.deal(last, n, C.CHUNK).groupBy(C.CHUNK)).applyInArrow(C.lean_pair(cut), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans array<struct<first: long, end: long>>, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suffix_dedup() of all documents; see there for nulls, repeats and empty tables."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
