"""Merkle manifests, SentencePiece tables and collocations against brute force and the library."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from dealflow.llm import collocations, merkle, pieces

from .test_operators import rows

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx string, n int, c0 int, path string"


def documents(n=700):
    """Sources from a single leaf to hundreds, a null one, nulls everywhere, repeated rows and ids, and a long text."""
    r = random.Random(3)
    texts = [t and (t.title() if i % 3 else t) for i, (_, t, *_) in enumerate(rows())]
    out = []
    for i in range(n):
        source = r.choice(["a", "a", "a", "é", "z" * (i % 5), None])
        out.append((r.choice([i, i, i, 7, None]), source, r.choice(["en", None, "und"]), r.choice([i, None]), texts[i % len(texts)], "x", 1, 2, None))
    out += [out[3]] * 300 + [(5000, "single", "en", 1, "A Lone Leaf", None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return sha(*map(part, row[:5]))


def lowered(row):
    t = row[4]
    return (*row[:4], t and re.sub("[A-Z]", lambda m: m[0].lower(), t))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def runs_of(levels, at):
    for level in levels[:-1]:
        first = at - at % 16
        run = level[first : first + 16]
        yield run[: at - first], run[at - first + 1 :]
        at //= 16


def test_merkle(spark, docs, empty):
    by = collections.defaultdict(list)
    for r in documents():
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = levels_of([leaf_of(r) for r in by[s]])
    top = levels_of([trees[s][-1][0] for s in sources])
    want = collections.Counter()
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            way = [*runs_of(trees[s], i), *runs_of(top, k)]
            folded = leaf_of(lowered(r)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf_of(r)
            for left, right in way:
                folded = sha(*left, folded, *right)
            proof = [x for left, right in way for x in (*left, *right)]
            want[r[0], leaf_of(r), trees[s][-1][0], top[-1][0], sha(*proof), folded, folded == top[-1][0], tuple(proof)] += 1
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    run = lambda d: merkle.manifest(d, {"text": lower}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    got = run(docs).collect()
    cells = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert collections.Counter((*(r[c] for c in cells), tuple(r.proof)) for r in got) == want
    assert not all(r.verified for r in got)
    assert merkle.manifest(empty).count() == 0
    assert {r.root for r in merkle.manifest(docs.repartition(7)).collect()} == {top[-1][0]}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097])
def test_merkle_sizes(spark, n):
    data = spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "concat('Text ', id) AS text")
    got = merkle.manifest(data).collect()
    levels = levels_of([leaf_of((i, "s", "en", i, f"Text {i}")) for i in range(n)])
    assert len(got) == n and {r.root for r in got} == {levels[-1][0]} and all(r.verified for r in got)
    for r in got[:: max(1, n // 20)]:
        assert r.proof == [x for left, right in runs_of(levels, r.doc_id) for x in (*left, *right)]


PIECES = [*"ab thein\n\t▁é中①\x00  ", "the ", "ing", " \n", "  ", "and", "▁▁", "<s>", "<0x0A>", "\r\n", "　"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_piece_model(library):
    with open(pieces.default_model(), "rb") as f:
        own = pieces.PieceModel(f.read())
    r = random.Random(11)
    for _ in range(4000):
        t = "".join(r.choice(PIECES) for _ in range(r.randint(0, 60)))
        assert own.encode(t) == library.encode(t) and own.decode(own.encode(t)) == library.decode(library.encode(t))
        ids = [r.randrange(3, 400) for _ in range(r.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)
    long = "".join(r.choice("abcdeinghtosr") for _ in range(20000))
    assert own.encode(long) == library.encode(long)


@pytest.mark.parametrize("chunks", [1, 3, 23])
def test_pieces(spark, empty, library, chunks):
    r = random.Random(5)
    texts = [t for _, t, *_ in rows()] + ["".join(r.choice(PIECES) for _ in range(k)) for k in range(50)]
    data = [(None if i % 9 == 4 else i % 40, t, "x", 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(data, "doc_id long, text string, words string, c0 int").repartition(3)
    want = collections.Counter()
    for i, t, *_ in data:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), tuple(ids), library.decode(ids)] += 1
    got = pieces.encode_documents(frame, pieces.default_model(), chunks=chunks).collect()
    assert collections.Counter((*x[:4], tuple(x.token_ids), x.decoded) for x in got) == want
    assert pieces.encode_documents(empty.select("doc_id", "text"), pieces.default_model()).count() == 0


def phrases_of(data, least, inside, top):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting."""
    f, n = collections.Counter(), collections.Counter()
    for lang, t in data:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    scored = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [x for x in f if x[0] == lang and f[x] >= least and len(x[1]) > len(w) and any(x[1][i : i + len(w)] == w for i in range(len(x[1]) - len(w) + 1))]
        if any(100 * f[x] >= inside * a for x in longer):
            continue
        scored[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang in scored for i, (score, a, p, left, right) in enumerate(sorted(scored[lang])[:top])]


@pytest.mark.parametrize("chunks", [1, 3, 23])
def test_collocations(spark, empty, chunks):
    r = random.Random(9)
    words = "the of and a in to über 中文 x river".split()
    data = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", "\n", ". "]) for _ in range(r.choice([0, 3, 40])))) for _ in range(120)]
    data += [("en", "New York City hall  " * 30), ("en", "new york city"), ("de", None), ("de", "New York!York new" * 20), ("x", "of\rthe"), ("y", "a b\x0ba b\x0ca b a\x1cb " * 10)] + [data[0]] * 20
    frame = spark.createDataFrame([(*x, "k", 1) for x in data], "lang string, text string, phrase string, f int").repartition(3)
    want = phrases_of(data, 5, 80, 25)
    got = collocations.collocations(frame, least=5, top=25, chunks=chunks).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 40
    assert collocations.collocations(empty).count() == 0


def test_misra_gries_keeps_the_frequent():
    """Whatever the order and number of summaries, an item of ``least`` occurrences has a counter, and counters bound counts."""
    r = np.random.default_rng(4)
    for least, distinct in ((30, 3000), (5, 400), (2, 50)):
        items = r.zipf(1.3, 20000) % distinct
        parts = np.array_split(r.permutation(items), 40)
        summaries = [tuple(x.astype(t) for x, t in zip(np.unique(p, return_counts=True), (np.uint64, np.int64))) for p in parts]
        capacity = len(items) // least + 1
        keys, counts, cut = collocations.merged(summaries, capacity)
        true = dict(zip(*np.unique(items, return_counts=True)))
        assert len(keys) <= capacity and cut * (capacity + 1) <= len(items) and cut < least
        assert {k for k, c in true.items() if c >= least} <= set(keys.tolist())
        assert all(c <= true[k] <= c + cut for k, c in zip(keys.tolist(), counts.tolist()))
        again = collocations.merged([collocations.merged(summaries[:20], capacity)[:2], collocations.merged(summaries[20:], capacity)[:2]], capacity)
        assert {k for k, c in true.items() if c >= least} <= set(again[0].tolist())
