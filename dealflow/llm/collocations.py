"""Phrases of two to four words that occur more often than their parts would suggest.

A phrase needs at least ``least`` occurrences, and no n-gram is rare whose longer phrase is frequent. Finding them all
without a table of all n-grams takes summaries and a second pass:

1. each chunk of documents counts its words and pairs by 64-bit hashes and sends them to hash partitions. A partition
   merges what its chunks send into a Misra-Gries summary, whose capacity exceeds the partition's mass divided by
   ``least``: merging cuts all counters by less than ``least`` in total, so every frequent n-gram keeps a counter;
   those whose counter and cut together stay below ``least`` are not frequent and go. Each chunk hears which of its
   n-grams are left;
2. triples and quadruples are summed up the same way, but only where all their pairs are left;
3. each chunk counts the n-grams that are left exactly and sends their texts, sorted and compressed, to the partitions,
   which add up by text. So a clash of hashes or a counter too high in a summary costs an entry and changes nothing.

All else (scores of cuts, phrases inside longer ones, ranks) is joins and grouping of frequent n-grams.
"""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CHUNK_BYTES = 16 << 20
#: Text whose words are hashed at once.
RUN_BYTES = 4 << 20
LEAST, TOP, LONGEST = 30, 2000, 4
#: Parts that the phrases of one language are dealt to, and those around one word.
PARTS, WORD_PARTS = 64, 16
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09]] = True
BREAKS = np.zeros(256, bool)
BREAKS[[ord(b) for b in ".,;:!?\n\v\f\r"]] = True


class _Words:
    """The words of one run of documents, in order, with hashes and ends of the pieces that n-grams stay in."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: list[str]):
        self.data = C.lower_ascii(data)
        self.starts, self.ends, self.bounds = C.word_bounds(self.data, off, SPACES | BREAKS)
        self.doc = C.doc_of(self.bounds)
        self.lang = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)[self.doc] if len(langs) else np.zeros(0, np.uint64)
        piece = np.cumsum(BREAKS[self.data])[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        same = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.h = C.word_hashes(self.data, self.starts, self.ends)
        self.other = None
        self.fits = {1: np.ones(len(self.h), bool)}
        for k in range(2, LONGEST + 1):
            fit = np.zeros(len(self.h), bool)
            if len(self.h) >= k:
                fit[: len(self.h) - k + 1] = self.fits[k - 1][: len(self.h) - k + 1] & same[k - 2 :]
            self.fits[k] = fit

    def keys(self, k: int, other: bool = False) -> np.ndarray:
        """A hash of language, length and words for each place, valid where fits[k]; other: a second one, made from other hashes of words."""
        out = np.zeros(len(self.h), np.uint64)
        if len(self.h) >= k:
            if other and self.other is None:
                self.other = C.word_hashes(self.data, self.starts, self.ends, True)
            w = C.window_hashes(self.other if other else self.h, k)
            out[: len(w)] = C.mix(w * np.uint64(2 * k + 1) + self.lang[: len(w)])
        return out

    def left(self, k: int, among: np.ndarray) -> np.ndarray:
        """Places whose n-gram of k words is among those left."""
        return self.fits[k] & C.found(self.keys(k), among)[1]

    def longer(self, k: int, pairs: np.ndarray) -> np.ndarray:
        """Places of n-grams of k words all of whose pairs are left."""
        out = self.fits[k].copy()
        n = len(out)
        for i in range(k - 1):
            out[: n - i] &= pairs[i:]
        return out


def _runs(rows: pa.Table):
    docs = C.unpacked_docs(rows)
    langs = docs["c1"].to_pylist()
    for a, b, data, off in C.pieces(docs["c0"], RUN_BYTES):
        yield _Words(data, off, langs[a:b]), langs[a:b]


def _counted(parts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts and their counts; a part is counted before the next one is made."""
    counted = [np.unique(p, return_counts=True) for p in parts] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    return _summed(np.concatenate([k for k, _ in counted]), np.concatenate([c for _, c in counted]))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def merged(summaries, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary of summaries (keys, counts): keys, counters, and by how much counters may be too low.

    What came in is added up once it outgrows the capacity; then all counters are cut by the largest one beyond the
    capacity. Each cut takes as much from capacity + 1 counters at least, so all cuts together stay at or below
    mass / (capacity + 1).
    """
    keys, counts, cut, wait, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, [], 0

    def add():
        nonlocal keys, counts, cut
        keys, counts = _summed(np.concatenate([keys, *(x for x, _ in wait)]), np.concatenate([counts, *(x for _, x in wait)]))
        if len(keys) > capacity:
            over = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
            cut += over
            keys, counts = keys[counts > over], counts[counts > over] - over

    for summary in summaries:
        wait.append(summary)
        size += len(summary[0])
        if size > max(capacity, 1 << 16):
            add()
            wait, size = [], 0
    add()
    return keys, counts, cut


def _survivors(asked: DataFrame, buckets: int, least: int, kind: int) -> DataFrame:
    """(chunk, bucket, kind, bits): which of the keys that a chunk asked a partition for its summary cannot rule out.

    asked: (bucket, chunk, blob). The answer is a bit for each key, in the order of the question.
    """

    def answer(rows: pa.Table) -> pa.Table:
        blobs = [C.unsqueezed(b) for b in rows["blob"].to_pylist()]
        mass = sum(int(c.sum(dtype=np.int64)) for _, c in blobs)
        keys, counts, cut = merged(((k, c.astype(np.int64)) for k, c in blobs), mass // least + 1)
        keys = keys[counts + cut >= least]
        bits = pa.array([C.squeezed_bits(C.found(k, keys)[1]) for k, _ in blobs], pa.binary())
        return pa.table({C.CHUNK: rows[C.CHUNK], C.BUCKET: rows[C.BUCKET], "kind": pa.array([kind] * len(blobs), pa.int32()), "bits": bits})

    return C.deal(asked, buckets, C.BUCKET).groupBy(C.BUCKET).applyInArrow(C.lean(answer), f"{C.CHUNK} int, {C.BUCKET} int, kind int, bits binary")


def _left(answer: pa.Table, kind: int, keys: np.ndarray) -> np.ndarray:
    """Of all keys that a chunk asked for, in order, those that are left."""
    rows = sorted((b, x) for b, k, x in zip(answer[C.BUCKET].to_pylist(), answer["kind"].to_pylist(), answer["bits"].to_pylist()) if k == kind)
    return keys[np.concatenate([np.zeros(0, bool), *(C.unsqueezed_bits(x) for _, x in rows)])]


def _request(chunk: int, buckets: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    cut = np.r_[0, np.searchsorted(keys, C.edges(buckets)), len(keys)]
    full = np.flatnonzero(np.diff(cut))
    blobs = [C.squeezed(keys[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]]) for b in full]
    return pa.table({C.BUCKET: pa.array(full, pa.int32()), C.CHUNK: pa.array(np.full(len(full), chunk), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _texts(lang: list, phrase: list, bucket, k: list, f) -> pa.Table:
    phrase = pa.array(phrase, pa.binary()).cast(pa.string())
    return pa.table({"b": pa.array(bucket, pa.int32()), "lang": pa.array(lang, pa.string()), "phrase": phrase, "k": pa.array(k, pa.int32()), "f": pa.array(f, pa.int64())})


def _sums(parts: list[pa.Table], keys: list[str]) -> pa.Table:
    return pa.concat_tables(parts).group_by(keys).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})


def frequent_ngrams(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", chunks: int | None = None) -> DataFrame:
    """(lang, phrase, k, f): all n-grams of one to four words with f >= least occurrences; and (lang, null, 0, number of words).

    Texts are lower-cased (A-Z), cut at .,;:!? and line ends, and cut into words at spaces and tabs. A null text counts as
    empty, a null lang as und. Each row counts, repeated ones too; very long texts are counted whole; ties do not arise.
    Further columns are left out. An empty table gives an empty result. chunks: see common.
    """
    spark = docs.sparkSession
    n = chunks or C.chunk_count(C.text_bytes(docs, text_col), spark, CHUNK_BYTES)
    named = docs.select(F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    x = C.packs(named, n, ["text", "lang"], "text")

    def short_keys(rows: pa.Table):
        return (w.keys(k)[w.fits[k]] for w, _ in _runs(rows) for k in (1, 2))

    def long_keys(rows: pa.Table, among: np.ndarray):
        for w, _ in _runs(rows):
            pairs = w.left(2, among)
            for k in range(3, LONGEST + 1):
                yield w.keys(k)[w.longer(k, pairs)]

    def first(rows: pa.Table) -> pa.Table:
        return _request(rows[C.CHUNK][0].as_py(), n, *_counted(short_keys(rows)))

    def second(rows: pa.Table, answer: pa.Table) -> pa.Table:
        among = _left(answer, 0, _counted(short_keys(rows))[0])
        return _request(rows[C.CHUNK][0].as_py(), n, *_counted(long_keys(rows, among)))

    def exact(rows: pa.Table, answer: pa.Table) -> pa.Table:
        short = _left(answer, 0, _counted(short_keys(rows))[0])
        among, parts = np.sort(np.r_[short, _left(answer, 1, _counted(long_keys(rows, short))[0])]), []
        for w, langs in _runs(rows):
            words = collections.Counter()
            for lang, c in zip(langs, np.diff(w.bounds).tolist()):
                words[lang] += c
            parts.append(_texts(list(words), [None] * len(words), [0] * len(words), [0] * len(words), list(words.values())))
            raw, edges = w.data.tobytes(), C.edges(n)
            for k in range(1, LONGEST + 1):
                at = np.flatnonzero(w.left(k, among))
                # Two hashes of 64 bits tell n-grams of one run apart; sums are made over their texts.
                a, b = w.keys(k)[at], w.keys(k, True)[at]
                order = np.lexsort((b, a))
                a, b, at = a[order], b[order], at[order]
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else at
                first, last = w.starts[at[new]].tolist(), w.ends[at[new] + k - 1].tolist()
                texts = [raw[s:e] for s, e in zip(first, last)] if k == 1 else [b" ".join(raw[s:e].split()) for s, e in zip(first, last)]
                parts.append(_texts([langs[d] for d in w.doc[at[new]].tolist()], texts, np.searchsorted(edges, a[new], "right"), [k] * len(new), np.diff(np.r_[new, len(a)])))
        t = _sums(parts, ["b", "lang", "phrase", "k"]).sort_by([("b", "ascending"), ("lang", "ascending"), ("phrase", "ascending")])
        buckets, first = np.unique(np.asarray(t["b"]), return_index=True)
        blobs = [C.zipped(t.slice(s, e - s).select(["lang", "phrase", "k", "f"])) for s, e in zip(first, [*first[1:], t.num_rows])]
        return pa.table({C.BUCKET: pa.array(buckets, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def total(rows: pa.Table) -> pa.Table:
        t = _sums([C.unzipped(b.as_py()) for b in rows["blob"]], ["lang", "phrase", "k"])
        return t.filter(pc.or_(pc.greater_equal(t["f"], least), pc.is_null(t["phrase"]))).select(["lang", "phrase", "k", "f"])

    blob = f"{C.BUCKET} int, {C.CHUNK} int, blob binary"
    groups = x.groupBy(C.CHUNK)
    short = C.deal(_survivors(groups.applyInArrow(C.lean(first), blob), n, least, 0), n, C.CHUNK)
    long = C.deal(_survivors(groups.cogroup(short.groupBy(C.CHUNK)).applyInArrow(C.lean_pair(second), blob), n, least, 1), n, C.CHUNK)
    both = C.deal(short.union(long), n, C.CHUNK)
    counted = C.deal(groups.cogroup(both.groupBy(C.CHUNK)).applyInArrow(C.lean_pair(exact), f"{C.BUCKET} int, blob binary"), n, C.BUCKET)
    return counted.groupBy(C.BUCKET).applyInArrow(C.lean(total), "lang string, phrase string, k int, f long")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = 80, top: int = TOP, text_col: str = "text", lang_col: str = "lang", chunks: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    a: the phrase's occurrences, l and r those of its parts at the cut with the lowest score, floor(2000000 a / (l + r)), the
    first of equal ones. A phrase goes where a longer one that holds it has at least ``inside`` percent of its occurrences.
    Ties of score go by a, then by the phrase's bytes, so ranks are defined. See frequent_ngrams() for awkward input.

    Frequent n-grams are written once. Parts are looked up by a join with a part of the phrase's hash in its key, so the
    phrases that start with one frequent word spread; first each part of a language ranks its own, then the language.
    """
    t = C.saved(frequent_ngrams(docs, least, text_col, lang_col, chunks))
    grams = t.where("phrase IS NOT NULL")
    longer = grams.where("k > 1").withColumn("w", F.split("phrase", " "))
    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = longer.select("lang", "phrase", "k", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    spread = lambda x: F.pmod(F.xxhash64(x), F.lit(PARTS)).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("cut").alias("size"), part(1, F.col("cut")).alias("piece")), F.struct(F.lit(1).alias("side"), (F.col("k") - F.col("cut")).alias("size"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("piece")))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", F.explode(sides).alias("x"))
    # A word may stand in a great share of all phrases, so it has a row for each part; longer pieces have one.
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", "x.side", "x.piece", F.when(F.col("x.size") == 1, F.pmod(F.xxhash64("phrase"), F.lit(WORD_PARTS))).otherwise(0).cast("int").alias("part"))
    parts = F.when(F.col("k") == 1, F.sequence(F.lit(0), F.lit(WORD_PARTS - 1))).otherwise(F.array(F.lit(0)))
    pieces = grams.where(f"k < {LONGEST}").select("lang", F.col("phrase").alias("piece"), "f", F.explode(parts).alias("part"))
    looked = cuts.join(pieces, ["lang", "piece", "part"])
    places = [(i, side) for i in range(1, LONGEST) for side in (0, 1)]
    at = looked.groupBy("lang", "phrase", "a").agg(*(F.max(F.when((F.col("cut") == i) & (F.col("side") == side), F.col("f"))).alias(f"f{i}_{side}") for i, side in places))
    score = "CAST(CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0)) DIV (CAST(f{i}_0 AS DECIMAL(20, 0)) + CAST(f{i}_1 AS DECIMAL(20, 0))) AS BIGINT)"
    cut = lambda i: F.when(F.col(f"f{i}_0").isNotNull(), F.struct(F.expr(score.format(i=i)).alias("score"), F.lit(i).alias("cut"), F.col(f"f{i}_0").alias("l"), F.col(f"f{i}_1").alias("r")))
    scored = at.select("lang", "phrase", "a", F.least(*(cut(i) for i in range(1, LONGEST))).alias("best"))
    subs = longer.where("k > 2").select("lang", "f", "w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"), "k")
    subs = subs.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("first"))
    held = subs.groupBy("lang", part(F.col("first"), F.col("size")).alias("phrase")).agg(F.max("f").alias("most"))
    free = scored.join(held, ["lang", "phrase"], "left").where(f"most IS NULL OR 100 * CAST(most AS DECIMAL(20, 0)) < {int(inside)} * CAST(a AS DECIMAL(20, 0))")
    order = [F.desc("best.score"), F.desc("a"), F.asc("phrase")]
    own = Window.partitionBy("lang", "part").orderBy(*order)
    few = free.withColumn("part", spread("phrase")).withColumn("own", F.row_number().over(own)).where(F.col("own") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = t.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collocations() of all documents; see there for nulls, blanks, repeats and empty tables."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * u.a // (x.f + y.f))::BIGINT AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, z, unnest(range(1, k - z + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS z) WHERE z < k) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase
WHERE h.most IS NULL OR 100::HUGEINT * h.most < 80::HUGEINT * b.a
QUALIFY rank <= 2000
"""
