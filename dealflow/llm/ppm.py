"""Language-model scores by prediction by partial matching (PPM).

A text is taken as its words, lower-cased in A-Z and joined by one space, and an end symbol. The model is a trie
of byte contexts up to order 5 over the training documents. A symbol is coded in its longest context that was
seen; where the context has not seen the symbol, an escape is coded (method D: each distinct
symbol gives half a count to the escape) and the next shorter context is asked, with the symbols of the longer one
excluded; below order 0 all symbols left are alike. The model is pretrained: counts of all training documents
come first, then every document gets the length of its code.

With fixed counts a context's symbols contain those of each longer one, so what is excluded at order k depends
on the context of order k + 1 alone, and each 6-byte string (context and symbol) has one code length. Hence:

* chunks of documents send their distinct 6-byte strings with training counts to buckets by a spread of the whole
  string, so that a frequent context does not meet in one bucket; a bucket sums each string's counts;
* buckets send their sums on by the last two bytes of the context, each string once for the whole corpus. So
  all counts of orders 2 to 5 of a context are in one place; orders 0 and 1 are a table of 256 x 256. There
  the code length of each string is computed;
* buckets answer each chunk in the order it asked, and chunks look up every position of every text and sum.

The first exchange carries the distinct words of each chunk and their training counts for the base score, too. What
is gathered grows with the input. A task holds a chunk, a bucket, or the distinct strings of a few contexts of
two bytes, whose number the language bounds and not the size of the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER = 5
END = 0x0A
#: Bytes that can occur: all but white space, and the space and the end symbol.
ALPHABET = 256 - 4
PIECE = 2 << 20
#: An odd factor and its inverse modulo 2^64.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
UNSPREAD = np.uint64(pow(int(SPREAD), -1, 1 << 64))
PAIR_BITS = 16


def _symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as symbols with ORDER end symbols before each; the first position and the number of symbols of each."""
    raw = C.lower_ascii(data).tobytes()
    texts = [b" ".join(raw[a:b].split()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    pad = bytes([END]) * ORDER
    flat = np.frombuffer(pad + pad.join(texts) + bytes([END]), np.uint8)
    first = ORDER + np.r_[0, np.cumsum(size - 1 + ORDER)[:-1]]
    return flat, first, size


def _keys(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each symbol its context of order 5 and itself, spread over the 64-bit key space; _string() undoes it."""
    x = flat.astype(np.uint64)
    n = len(x) - ORDER
    key = x[:n].copy()
    for i in range(1, ORDER + 1):
        key <<= np.uint64(8)
        key |= x[i : n + i]
    at = np.repeat(first - ORDER - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    return key[at] * SPREAD


def _string(key: np.ndarray) -> np.ndarray:
    return key * UNSPREAD


def _by_pair(key: np.ndarray) -> np.ndarray:
    """A 6-byte string with a spread of its last two context bytes in front."""
    return ((((key >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(0x9E3B)) & np.uint64(0xFFFF)) << np.uint64(48) | key


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts in order, and the sums of their counts."""
    keys = np.concatenate([k for k, _ in parts] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([c for _, c in parts] or [np.zeros(0, np.int64)])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class Places:
    """Open addressing over distinct keys: the place of each of many keys, all of them known."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def _slot(self, keys):
        return (C.mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at = self.slots[slot]
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            at[wrong] = self.slots[slot[wrong]]
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return at


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each distinct 6-byte string, whose last two context bytes have all their strings here.

    counts: training counts; pairs[b, s]: training count of symbol s after byte b, over the whole corpus.
    """
    key = keys & np.uint64((1 << 48) - 1)
    symbol, before = (key & np.uint64(255)).astype(np.int64), ((key >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    single = pairs.sum(axis=0)
    # For each string and order: count of the symbol in the context, sum and number of the context's symbols.
    count, total, kinds, node, context = {}, {}, {}, {}, {}
    for k in range(ORDER, 1, -1):
        low = key & np.uint64((1 << 8 * (k + 1)) - 1)
        _, one, node[k] = np.unique(low, return_index=True, return_inverse=True)
        sums = np.bincount(node[k], weights=counts, minlength=len(one))
        _, context[k] = np.unique(low >> np.uint64(8), return_inverse=True)
        of = context[k][one]
        count[k] = sums[node[k]]
        total[k] = np.bincount(of, weights=sums)[context[k]]
        kinds[k] = np.bincount(of, weights=sums > 0)[context[k]]
        node[k] = one
    count[1], total[1], kinds[1] = pairs[before, symbol].astype(float), pairs.sum(axis=1)[before].astype(float), (pairs > 0).sum(axis=1)[before].astype(float)
    count[0], total[0], kinds[0] = single[symbol].astype(float), np.full(len(key), float(single.sum())), np.full(len(key), float((single > 0).sum()))
    out, open_ = np.zeros(len(key)), np.ones(len(key), bool)
    for k in range(ORDER, -1, -1):
        if k == ORDER:
            gone, gone_kinds = 0.0, 0.0
        else:
            gone_kinds = kinds[k + 1]
            if k + 1 >= 2:  # what the symbols seen in the longer context weigh here
                one = node[k + 1]
                w = np.where(count[k + 1][one] > 0, count[k][one], 0.0)
                gone = np.bincount(context[k + 1][one], weights=w)[context[k + 1]]
            else:
                gone = (np.where(pairs > 0, single[None, :], 0).sum(axis=1))[before].astype(float)
        n, d = total[k] - gone, kinds[k] - gone_kinds
        has = open_ & (count[k] > 0)
        out[has] += np.log10((2 * count[k][has] - 1) / (2 * n[has]))
        open_ &= ~has
        escape = open_ & (d > 0)
        out[escape] += np.log10(d[escape] / (2 * n[escape]))
    out[open_] -= math.log10(max(1, ALPHABET - int((single > 0).sum())))
    return out


def _training(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, int, int]:
    """Pair table, documents and word tokens of the training documents; at most 256 x 256 rows reach the driver."""

    def run(batches):
        pairs, n_docs, n_words = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for _, _, data, off in C.pieces(batch.column(0), PIECE):
                flat, first, size = _symbols(data, off)
                at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                x = flat.astype(np.int64)
                pairs += np.bincount((x[at - 1] << 8) | x[at], minlength=1 << 16)
                n_docs += len(size)
                n_words += int((flat == 0x20).sum() + (size > 1).sum())
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(np.r_[at, -1, -2]), "n": pa.array(np.r_[pairs[at], n_docs, n_words])})

    got = docs.where("NOT __held").select(text_col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs, rest = np.zeros(1 << 16, np.int64), {-1: 0, -2: 0}
    for r in got:
        if r["pair"] >= 0:
            pairs[r["pair"]] = r["n"]
        else:
            rest[r["pair"]] = r["n"]
    return pairs.reshape(256, 256), rest[-1], rest[-2]


def ppm_scores(docs: DataFrame, held: "F.Column | None" = None, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    held: documents that the model does not learn from; by default those whose crc32 of the doc_id as text is 2
    modulo 7 (a null doc_id has an empty text). Tokens are words and one end a document. base_score sums
    log10((c + 1) / (N + V + 1)) over tokens; score is the model's log10 probability of the text. A null or blank
    text is an end alone. Without training documents every symbol is alike. Repeated rows count as often as they
    stand; other columns play no part. A very long text is read in one piece by one task, whole. An empty table gives
    an empty result. chunks: the number of chunks, by default from the size of the input; it changes no result.
    """
    spark = docs.sparkSession
    if held is None:
        held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = docs.select(F.col(id_col), F.col(text_col), held.alias("__held"))
    n = chunks or C.chunk_count(C.text_bytes(docs, text_col), spark)
    pairs, n_train, n_words = _training(docs, id_col, text_col)
    table = spark.sparkContext.broadcast(pairs)
    x = C.chunked(docs, n, id_col, text_col)

    def distinct(rows: pa.Table):
        grams, words = [], []
        held_ = np.asarray(rows["__held"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        for a, b, data, off in C.pieces(rows[text_col], PIECE):
            flat, first, size = _symbols(data, off)
            keys, out = _keys(flat, first, size), np.repeat(held_[a:b], size)
            k, c = _distinct(keys[~out])
            grams.append((k, c))
            k, c = _distinct(keys[out])
            grams.append((k, c * 0))
            low = C.lower_ascii(data)
            starts, ends, bounds = C.word_bounds(low, off)
            h, out = C.word_hashes(low, starts, ends), np.repeat(held_[a:b], np.diff(bounds))
            k, c = _distinct(h[~out])
            words.append((k, c))
            k, c = _distinct(h[out])
            words.append((k, c * 0))
        return _merge(grams), _merge(words)

    def ask(rows: pa.Table) -> pa.Table:
        (gk, gc), (wk, wc) = distinct(rows)
        chunk = rows[C.CHUNK][0].as_py()
        g = C.packed(chunk, n, gk, gc.astype(np.int64))
        w = C.packed(chunk, n, wk, wc.astype(np.int64))
        w = w.set_column(0, C.BUCKET, pa.array(np.asarray(w[C.BUCKET]) + n, pa.int32()))
        return pa.concat_tables([g, w])

    def sums_of(rows: pa.Table):
        """Keys as they came, their rows, and the distinct ones in order with their sums over all chunks."""
        keys, row = C.unpacked(rows, "keys", np.uint64)
        return keys, row, *_merge([(keys, C.unpacked(rows, "c0", np.int64)[0])])

    def in_pairs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings of a bucket by pair of context bytes, and their order."""
        by = _by_pair(_string(own))
        order = np.argsort(by)
        return by[order], order

    def contexts(rows: pa.Table) -> pa.Table:
        bucket = rows[C.BUCKET][0].as_py()
        if bucket >= n:
            return C.packed(bucket, n, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        _, _, own, sums = sums_of(rows)
        by, order = in_pairs(own)
        return C.packed(bucket, n, by, sums[order], bits=PAIR_BITS)

    def lengths(rows: pa.Table) -> pa.Table:
        keys, row = C.unpacked(rows, "keys", np.uint64)
        value = code_lengths(keys, C.unpacked(rows, "c0", np.int64)[0], table.value).astype(np.float32)
        cut = np.r_[0, np.cumsum(np.bincount(row, minlength=rows.num_rows))]
        return pa.table({C.BUCKET: rows[C.CHUNK], "pair": rows[C.BUCKET], "value": pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    def answer(rows: pa.Table, told: pa.Table) -> pa.Table:
        bucket = rows[C.BUCKET][0].as_py()
        keys, row, own, sums = sums_of(rows)
        value = sums
        if bucket < n:
            value = np.zeros(len(own), np.float32)
            value[in_pairs(own)[1]] = C.flat(told.sort_by("pair"), "value", np.float32)
        value = value[C.found(keys, own)[0]]
        cut = np.r_[0, np.cumsum(np.bincount(row, minlength=rows.num_rows))]
        new = np.zeros(rows.num_rows, np.int64)
        new[0] = int((sums > 0).sum()) if bucket >= n else 0
        return pa.table({C.CHUNK: rows[C.CHUNK], C.BUCKET: rows[C.BUCKET], "answer": pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), "known": pa.array(new)})

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        (gk, _), (wk, _) = distinct(rows)
        answers = answers.sort_by(C.BUCKET)
        blobs, buckets = answers["answer"].to_pylist(), np.asarray(answers[C.BUCKET])
        cut = int(np.searchsorted(buckets, n))
        code = np.frombuffer(b"".join(blobs[:cut]), np.float32).astype(np.float64)
        count = np.frombuffer(b"".join(blobs[cut:]), np.int64)
        grams, words = Places(gk), Places(wk)
        log = np.log10(count.astype(np.float64) + 1)
        n_tokens, n_known, base, total = [], [], [], []
        for _, _, data, off in C.pieces(rows[text_col], PIECE):
            flat, first, size = _symbols(data, off)
            v = code[grams.of(_keys(flat, first, size))]
            total.append(np.add.reduceat(v, np.r_[0, np.cumsum(size)[:-1]]))
            low = C.lower_ascii(data)
            starts, ends, bounds = C.word_bounds(low, off)
            at = words.of(C.word_hashes(low, starts, ends)) if len(starts) else np.zeros(0, np.int64)
            sums, known = np.r_[0.0, np.cumsum(log[at])], np.r_[0, np.cumsum(count[at] > 0)]
            n_tokens.append(np.diff(bounds) + 1)
            n_known.append(known[bounds[1:]] - known[bounds[:-1]] + (n_train > 0))
            base.append(sums[bounds[1:]] - sums[bounds[:-1]] + math.log10(n_train + 1))
        return pa.table({id_col: rows[id_col], "held_out": rows["__held"], "n_tokens": pa.array(np.concatenate(n_tokens)), "n_known": pa.array(np.concatenate(n_known)), "base": pa.array(np.concatenate(base)), "score": pa.array(np.concatenate(total))})

    asked = x.groupBy(C.CHUNK).applyInArrow(ask, f"{C.BUCKET} int, {C.CHUNK} int, keys binary, c0 binary")
    asked = C.deal(asked, 2 * n, C.BUCKET).groupBy(C.BUCKET)
    by_pair = asked.applyInArrow(C.lean(contexts), f"{C.BUCKET} int, {C.CHUNK} int, keys binary, c0 binary")
    told = C.deal(by_pair, n, C.BUCKET).groupBy(C.BUCKET).applyInArrow(C.lean(lengths), f"{C.BUCKET} int, pair int, value binary")
    told = C.deal(told, 2 * n, C.BUCKET).groupBy(C.BUCKET)
    answers = asked.cogroup(told).applyInArrow(C.lean_pair(answer), f"{C.CHUNK} int, {C.BUCKET} int, answer binary, known long")
    answers = C.deal(answers, n, C.CHUNK)

    def count_known(batches):
        yield pa.RecordBatch.from_pydict({"v": pa.array([sum(sum(b.column("known").to_pylist()) for b in batches)], pa.int64())})

    # The same exchange gives the number of distinct words, one number for the whole corpus.
    distinct_words = answers.mapInArrow(count_known, "v long").agg(F.sum("v").alias("v"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = x.groupBy(C.CHUNK).cogroup(answers.groupBy(C.CHUNK)).applyInArrow(score, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    tokens = n_words + n_train
    norm = F.log10(F.lit(float(tokens + 1 + (n_train > 0))) + distinct_words.scalar())
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score")


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ppm_scores() of all documents; see there for nulls, blanks, repeats and empty tables."""
    return ppm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
