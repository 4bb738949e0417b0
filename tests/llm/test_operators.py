"""Every operator against a brute-force version on small, awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from dealflow.llm import bpe, decontamination, graph, ppm, quality_rules, sharding, simhash_dedup, simhash_similarity, substring_dedup, suffix_dedup, token_counts, token_files

SCHEMA = "doc_id long, text string, n_words string, chunk int"
WORDS = "the of and a in to stone river light green walks under über été ñandú 中文 don't x".split()


def rows(seed=7, n=60):
    """Random texts, copies, near copies, shared passages, nulls, blanks, repeated rows, and a long text."""
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(k))
    shared, out = text(70), []
    for i in range(n):
        t = text(r.choice([0, 1, 2, 3, 40, 120]))
        if i % 5 == 1:
            t = f"{t} {shared}\n{text(10)}"
        if i % 11 == 3 and out:
            t = out[-1][1]
        out.append((1000 - 7 * i if i % 2 else 7 * i, t, "clash", 1))
    near = text(200)
    out += [(2000 + i, near.replace(near.split()[i * 9], f"new{i}", 1), "clash", 2) for i in range(4)]
    out += [(3000, None, None, None), (3001, "", None, None), (3002, " \t\n", None, None), (None, shared, None, None), (3003, text(4000), None, None)]
    out += [out[2], (3004, "the the the " * 60, None, None), (3005, "\x00 nul\x1c ünï  x", None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def lower(b):
    return bytes(x | 32 if 65 <= x <= 90 else x for x in b)


#: Chunks that documents are dealt to; the size of the test tables alone would give one.
CHUNKS = pytest.mark.parametrize("chunks", [1, 3, 59])


@CHUNKS
def test_substrings(docs, empty, chunks):
    first, n = {}, 50
    for i, t, *_ in rows():
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, math.inf), i if i is not None else math.inf)
    want = collections.Counter()
    for i, t, *_ in rows():
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (i if i is not None else math.inf):
                gone[k : k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    out = substring_dedup.substring_dedup(docs, chunks=chunks)
    got = out.collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 500 and "chunk" in out.columns
    assert all(sum(s.end - s.first for s in r.removed_spans) == r.n_removed for r in got)
    assert substring_dedup.substring_dedup(empty).count() == 0


@CHUNKS
def test_bytes(docs, empty, chunks):
    first, n = {}, 50
    for i, t, *_ in rows():
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first[b[k : k + n]] = min(first.get(b[k : k + n], math.inf), i if i is not None else math.inf)
    want = collections.Counter()
    for i, t, *_ in rows():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < (i if i is not None else math.inf):
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i, len(b), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.suffix_dedup(docs, chunks=chunks).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def components(pairs, ids):
    low = {i: i for i in ids}
    while True:
        new = dict(low)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


def test_simhash(docs, empty):
    import xxhash

    fps = []
    for i, t, *_ in rows():
        w = lower((t or "").encode()).split()
        sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    nodes = range(len(fps))
    low = components([(a, b) for a in nodes for b in nodes if a < b and (fps[a][1] ^ fps[b][1]).bit_count() <= 3], nodes)
    least = {}
    for k in nodes:
        if fps[k][0] is not None:
            least[low[k]] = min(least.get(low[k], math.inf), fps[k][0])
    want = collections.Counter((i, f, least.get(low[k])) for k, (i, f) in enumerate(fps))
    got = simhash_dedup.simhash_components(docs).collect()
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash_dedup.simhash_components(empty).count() == 0


def test_simhash_dense_cells(spark):
    """Cells that are cut into blocks give the same links as whole ones."""
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        fps |= {f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(30)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = [(e.a, e.b) for e in simhash_dedup.links(df, cell=8).collect()]
    pairs = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3]
    assert components(got, fps) == components(pairs, fps)


def test_similar_texts(docs, empty):
    out = simhash_similarity.near_dedup(docs)
    ids = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    assert out.columns == docs.columns and max(ids.values()) == 1
    assert 2000 in ids and not {2001, 2002, 2003} & set(ids)
    blank = {i for i, t, *_ in rows() if not words(t) and i is not None}
    assert blank & set(ids) == {min(blank)} and 3003 in ids
    assert simhash_similarity.near_dedup(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = [(1, "".join(x.upper() if x.isascii() else x for x in " ".join(rows()[1][1].split()[-45:-12]))), (2, "nothing like it in here at all"), (3, None), (4, ""), (5, "stone1 river2"), (6, rows()[-5 - 3][1] or "zz")]
    table = spark.createDataFrame(items, "item_id long, text string")
    sets = lambda t, n: {tuple(w[k : k + n]) for w in [lower((t or "").encode()).split()] for k in range(len(w) - n + 1)}
    want = collections.Counter()
    for i, t, *_ in rows():
        for j, u in items:
            n = min(5, len(words(u)))
            s = sets(u, n) if n else set()
            both = len(s & sets(t, n)) if n else 0
            if s and 10 * both >= 8 * len(s):
                want[i, j, both, len(s)] += 1
    for block_bytes in (1 << 20, 100, 1):
        got = decontamination.contained_items(docs, table, block_bytes=block_bytes).collect()
        assert collections.Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got) == want
    assert len(want) > 5
    clean = decontamination.decontaminated(docs, table)
    assert clean.columns == docs.columns and not {r.doc_id for r in clean.collect()} & {i for i, *_ in want}
    assert decontamination.contained_items(empty, table).count() == 0
    assert decontamination.contained_items(docs, table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def ppm_brute_force():
    data = []
    for i, t, *_ in rows():
        w = lower((t or "").encode()).split()
        data.append((i, zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2, w, b" ".join(w) + b"\n"))
    count, trie, total = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(6)], 0
    for _, held, w, s in data:
        if not held:
            count.update(w)
            count[None] += 1
            total += len(w) + 1
            x = b"\n" * 5 + s
            for p in range(5, len(x)):
                for k in range(6):
                    trie[k][x[p - k : p]][x[p]] += 1

    def code(x, p):
        out, gone = 0.0, set()
        for k in range(5, -1, -1):
            seen = {s: n for s, n in trie[k].get(x[p - k : p], {}).items() if s not in gone}
            if x[p] in seen:
                return out + math.log10((2 * seen[x[p]] - 1) / (2 * sum(seen.values())))
            if seen:
                out += math.log10(len(seen) / (2 * sum(seen.values())))
            gone |= set(seen)
        return out - math.log10(252 - len(gone))

    want = sorted((i if i is not None else -1, held, len(w) + 1, sum(count[t] > 0 for t in [*w, None]), sum(math.log10((count[t] + 1) / (total + len(count) + 1)) for t in [*w, None]), sum(code(b"\n" * 5 + s, p) for p in range(5, len(s) + 5))) for i, held, w, s in data)
    return want


@pytest.mark.parametrize("chunks", [1, 3, 59, 399])
def test_ppm(docs, empty, ppm_brute_force, chunks):
    want = ppm_brute_force
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in ppm.ppm_scores(docs, chunks=chunks).collect())
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in got], [x[4:] for x in want], rtol=1e-5)
    assert ppm.ppm_scores(empty).count() == 0


def test_sharding(spark, docs, empty):
    got = sharding.bounded_ring(docs, shards=5, vnodes=8).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows()) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    place = {r.place: r for r in sharding.ring(spark, 5, 8).collect()}
    assert len(place) == sharding.PLACES
    from pyspark.sql import functions as F

    keys = docs.select(F.xxhash64(F.lit("key"), "doc_id").alias("h")).collect()
    own = {r.arc: r.owner for r in place.values()}
    cap = [len(keys) // 5 + (s < len(keys) % 5) for s in range(5)]
    load = [0] * 5
    for arc, _ in sorted((place[(k.h % (1 << 64)) >> 48].arc, k.h) for k in keys):
        while load[own[arc]] >= cap[own[arc]]:
            arc = (arc + 1) % len(own)
        load[own[arc]] += 1
    assert load == [len(by[s]) for s in range(5)]
    size = collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert size == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert sharding.bounded_ring(empty).count() == 0
    loose = sharding.bounded_ring(docs, shards=5, vnodes=8, slack=0.25).groupBy("shard").count().collect()
    assert max(r["count"] for r in loose) <= math.ceil(len(keys) * 1.25 / 5)


def test_sharding_of_hot_keys(spark):
    """Rows without doc_id, all equal, and columns named like the operator's own."""
    table = [(None if i % 3 else i, "same", i, i, "x", i) for i in range(900)]
    df = spark.createDataFrame(table, "doc_id long, text string, arc int, place int, keys string, count int").repartition(5)
    out = sharding.bounded_ring(df)
    assert out.columns == ["doc_id", "arc", "place", "keys", "count", "size", "text_crc32", "shard", "slot"]
    got = out.collect()
    assert collections.Counter((r.doc_id, r.arc, r.place, r["count"]) for r in got) == collections.Counter((i, a, b, n) for i, _, a, b, _, n in table)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(by) == 40 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_components_of_hubs(spark, monkeypatch):
    """A hub with most of the edges, as least and as largest node, a path, loops, nulls and repeats."""
    r = random.Random(21)
    edges = [(5, i) for i in range(100, 400)] + [(i, 9999) for i in range(400, 600)] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(7, 7), (None, 3), (3, None), (5, 120), (120, 5)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = components(real, {x for e in real for x in e})
    df = spark.createDataFrame(edges, "a long, b long")
    for parts in (graph.PARTS, 1):
        monkeypatch.setattr(graph, "PARTS", parts)
        got = graph.components(df).collect()
        assert len(got) == len(want) and {x.node: x.component for x in got} == want


TEXTS = ["", "the THE  the\n", "Straße ΑΣ İstanbul", "<|endoftext|>a<|startoftext|> b", "don't we'll 123 $$$!!", "é é Å", "a\x1cb  c　d", "aaaaaaaaaaaa thethethe"]


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    lib = Tokenizer.from_file(path)
    own = bpe.PrefixBPE(open(path, "rb").read())
    words_ = token_files.WordEncoder(open(path, encoding="utf-8").read(), "<u2")
    r = random.Random(5)
    pool = [chr(x) for x in [*range(1, 0x180), *range(0x300, 0x320), *range(0x390, 0x3D0), 0x2003, 0x3000, 0x4E2D, 0x1F600]] + ["'s", "'ll", "the", "ing"]
    for t in TEXTS + ["".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(2000)]:
        want = lib.encode(t, add_special_tokens=False).ids
        ids, decoded, n = own.encode(t)
        assert np.frombuffer(words_.encode(t), "<u2").tolist() == want, t
        assert (np.frombuffer(ids, "<u4").tolist(), n, decoded) == (want, len(want), lib.decode(want, skip_special_tokens=False)), t
    df = docs.select("doc_id", "text", "chunk")
    got = {r.doc_id: r for r in bpe.encode_documents(df, path).collect()}
    for i, t, *_ in rows():
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].token_ids == want and got[i].decoded == lib.decode(want, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(empty, path).count() == 0


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_token_files(spark, docs, empty, tmp_path, parts):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    lib = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(5000 + i, t, None, None) for i, t in enumerate(TEXTS)], SCHEMA)
    index = token_files.write_tokens(docs.union(extra), f"file://{tmp_path}/a", path, parts=parts)
    got = sorted(token_files.read_tokens(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    data = sorted([(i if i is not None else -1, t or "") for i, t, *_ in rows()] + [(5000 + i, t) for i, t in enumerate(TEXTS)])
    at = 0
    assert len(got) == len(data) == index["docs"]
    for r, (i, t) in zip(got, data):
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        assert ((r.doc_id if r.doc_id is not None else -1), r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert index["tokens"] == at
    token_files.write_tokens(empty, f"file://{tmp_path}/b", path)
    assert token_files.read_tokens(spark, f"file://{tmp_path}/b").count() == 0


def test_quality(docs, empty):
    want = collections.Counter()
    for i, t, *_ in rows():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(tri)
        cover = {k + d for k, x in enumerate(tri) if n[x] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    got = quality_rules.weak_supervision(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in got if r.kept)
    assert quality_rules.weak_supervision(empty).count() == 0


def test_quality_of_long_texts(spark):
    """Millions of words leave few bits of a window's hash beside its place; no window may count as another's copy."""
    from pyspark.sql import functions as F

    n = 4_000_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.hex(i)), " ")
    df = spark.range(1).select(text.alias("text")).union(spark.range(1).select(F.concat(text, F.lit(" 1 2 3 4"))))
    got = quality_rules.weak_supervision(df).select("n_words", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got)) == [(n, 0, False), (n + 4, 8, False)]


def test_quality_fit_finds_accuracies():
    r, patterns = random.Random(1), collections.Counter()
    truth = collections.defaultdict(list)
    for _ in range(5000):
        good = r.random() < 0.8
        p = tuple(0 if r.random() < 0.2 else (1 if (r.random() < a) == good else -1) for a in (0.95, 0.9, 0.85, 0.9, 0.6))
        patterns[p] += 1
        truth[p].append(good)
    post = quality_rules.fit(patterns)
    right = sum(g == (post[p] >= 0.5) for p, gs in truth.items() for g in gs)
    assert right / 5000 > 0.95


def test_quality_on_labels(spark, sf):
    got = {r.doc_id: r for r in quality_rules.op9_quality_rules(spark, sf).collect()}
    lab = spark.read.parquet(f"{sf}/labels.parquet").collect()
    judged = [(r.quality == 1) == got[r.doc_id].kept for r in lab if not got[r.doc_id].base_failed]
    assert sum(judged) / len(judged) > 0.95


def test_rollup(spark, tmp_path):
    s = "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long"
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert roll.totals().count() == 0
    one = spark.createDataFrame([("insert", "a", "en", "v", None, 10), ("insert", "a", "en", "v", None, 5), ("insert", None, "en", "v", None, 7)], s)
    two = spark.createDataFrame([("delete", "a", "en", "v", 5, None), ("revise", "a", "en", "v", 10, 4), ("delete", None, "en", "v", 7, None)], s)
    assert roll.apply("1", one) and not roll.apply("1", one)
    assert roll.apply("2", two) and not roll.apply("2", one)
    assert roll.apply("3", spark.createDataFrame([], s))
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v", 1, 4)]
    assert roll.committed() == ["1", "2", "3"]
    with pytest.raises(Exception, match="unknown op"):
        roll.apply("4", spark.createDataFrame([("upsert", "a", "en", "v", 1, 1)], s))
    assert roll.committed() == ["1", "2", "3"]


def test_rollup_of_two_committers(spark, tmp_path):
    """Runs of one batch that both found nothing committed: one is counted, also after a run that ended halfway."""
    s = "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long, times long"
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    other = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    rows = [spark.createDataFrame([("insert", "a", "en", "v", None, 10, n)], s) for n in (1, 2)]
    found, first = roll._folders, []

    def late():  # the other run commits after this one has looked
        seen = found()
        if not first:
            first.append(other.apply("1", rows[1]))
        return seen

    roll._folders = late
    assert not roll.apply("1", rows[0]) and first == [True]
    roll._folders = found
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v", 2, 20)] and roll.committed() == ["1"]
    roll._fs.create(roll._path(f"{roll.folder}/batch=2"), False).close()
    assert roll.committed() == ["1"] and roll.apply("2", rows[0]) and not roll.apply("2", rows[0])
    assert [tuple(r)[3:] for r in roll.totals().collect()] == [(3, 30)]


def test_rollup_of_hot_copies(spark, tmp_path):
    """Copies with nulls and repeated rows against the same steps in Python."""
    r = random.Random(2)
    texts = ["a b", "x\nx\ny", "q, r!", None, ""]
    table = [(r.choice([None, 1, 2, i]), r.choice(texts), r.choice(["s", "t", None]), r.choice(["en", None]), "clash") for i in range(90)]
    spark.createDataFrame(table, "doc_id long, text string, source string, lang string, times string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda x: (x is not None, x)
    stay = {}
    for i, t, src, lang, _ in table:
        k = (i is None, i or 0, key(src), key(lang))
        stay[t or ""] = min(stay.get(t or "", (k, src, lang)), (k, src, lang), key=lambda v: v[0])
    want = collections.Counter()
    for t, (_, src, lang) in stay.items():
        once = "\n".join(dict.fromkeys(t.split("\n")))
        for name, p in token_counts.VERSIONS.items():
            n = len(re.findall(p, once))
            for level, cell in ((0, (None, None)), (1, (src, None)), (2, (src, lang))):
                want[level, *cell, name, "docs"] += 1
                want[level, *cell, name, "tokens"] += n
    got = collections.Counter()
    for x in token_counts.op10_token_counts(spark, str(tmp_path)).collect():
        got[x.level, x.source, x.lang, x.tokenizer, "docs"] += x.docs
        got[x.level, x.source, x.lang, x.tokenizer, "tokens"] += x.tokens
    assert +got == +want
    spark.createDataFrame([], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_counts.op10_token_counts(spark, f"{tmp_path}/none").count() == 0


def test_rollup_stream(spark, tmp_path):
    s = "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long"
    spark.createDataFrame([("insert", "a", "en", "v", None, 3)], s).write.parquet(f"{tmp_path}/in")
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    for _ in range(2):
        roll.apply_stream(spark.readStream.schema(s).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", "s").awaitTermination()
    assert [tuple(r)[3:] for r in roll.totals().collect()] == [(1, 3)]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf).persist()
        if name != "encode":
            assert out.columns == docs.columns
        assert 0 < out.count() <= before.count()
        before = out
    assert corpus_pipeline.run(spark, sf).count() == before.count()


def test_stages_on_awkward_tables(spark, docs, sf):
    """Stages on empty tables, and on rows with nulls, repeats and columns named like the operators' own."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{sf}/documents.parquet")
    plain = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    names = ["arc", "cell", "node", "fp", "bands", "block", "cut", "kept", "keys", "words", "item_id", "id", "k1", "size", "least", "a", "b", "i", "j", "component", "posterior", "n_shared", "__chunk_"]
    clash = plain.select("*", *(F.lit("x").alias(c) for c in names))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, real.limit(0), sf).count() == 0
        want = stage(spark, plain, sf)
        got = stage(spark, clash, sf)
        if name != "encode":
            assert want.columns == plain.columns and got.columns == clash.columns
        assert collections.Counter(r.doc_id for r in got.select("doc_id").collect()) == collections.Counter(r.doc_id for r in want.select("doc_id").collect())


def test_similar_dense_cells(spark):
    """Large cells, in pairs of blocks, give the same links as whole ones."""
    r = random.Random(4)
    base = [r.getrandbits(512) for _ in range(3)]
    fps = base + [b ^ sum(1 << r.randrange(512) for _ in range(r.randrange(1, 40))) for b in base for _ in range(25)]
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(64, "little"))) for i, f in enumerate(fps)], "node long, fp binary")
    parts = []
    for cell in (4, 1000):
        got = [(e.a, e.b) for e in simhash_similarity.similar_links(df, 77, cell=cell).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 3 * 77 for a, b in got)
        parts.append(components(got, range(len(fps))))
    assert parts[0] == parts[1] and len(set(parts[0].values())) == 3


def jaccard(t, u):
    a, b = ({tuple(w[k : k + n]) for w in [lower((x or "").encode()).split()] for n in [min(5, len(w))] for k in range(len(w) - n + 1)} for x in (t, u))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_texts_brute_force(spark):
    """Links are the pairs at 0.8 or more by exact Jaccard, close to the limit too, in groups of one block and of many."""
    r = random.Random(11)
    texts = []
    for _ in range(60):  # one run of n new words at an end takes n of the shingles
        n = r.choice([9, 30, 104, 204])
        w = [f"w{r.randrange(10**9)}" for _ in range(n)]
        m = r.randrange(0, round(0.3 * n) + 1) if n > 9 else r.randrange(3)
        texts += [" ".join(w), " ".join(w[m:]), " ".join([*(f"x{r.randrange(10**9)}" for _ in range(m // 2)), *w[m // 2 :]])]
    want = components([(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8], range(len(texts)))
    near = [jaccard(texts[i], texts[i - 1]) for i in range(1, len(texts), 3)]
    assert sum(0.7 < x < 0.8 for x in near) > 5 and sum(0.8 <= x < 0.88 for x in near) > 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block_bytes in (4 << 20, 700):
        got = {x.doc_id for x in simhash_similarity.near_dedup(df, block_bytes=block_bytes).collect()}
        assert got == set(want.values())


def test_similar_sets_not_repeats(spark):
    """Repeats of a shingle count once: a shared line makes no copies, a repeated one hides none."""
    r = random.Random(12)
    text = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    line, one = text(10), text(300)
    mixed = [" ".join(" ".join([*text(8), *line]) for _ in range(120)) for _ in range(2)]
    mixed = [f"{' '.join(line * 250)} {' '.join(text(1500))}" for _ in range(2)] + mixed
    copies = [" ".join(one), " ".join([*(one[:12] * 200), *one])]
    assert jaccard(*mixed[:2]) < 0.1 and jaccard(*copies) >= 0.8
    df = spark.createDataFrame(list(enumerate([*mixed, *copies])), "doc_id long, text string")
    assert {x.doc_id for x in simhash_similarity.near_dedup(df).collect()} == {0, 1, 2, 3, 4}


def test_rows_of_null_and_repeated_ids(spark):
    """Null and repeated doc_ids lose the judged texts only."""
    r = random.Random(13)
    texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(60)) for _ in range(9)]
    table = [(None, t, "a") for t in texts[:4]] + [(5, t, "b") for t in texts[4:7]] + [(7, texts[7], "c"), (None, texts[7], "d"), (5, texts[4] + " more", "e"), (None, texts[0], "a")]
    df = spark.createDataFrame(table, "doc_id long, text string, tag string")
    want = collections.Counter([(None, t) for t in texts[:4]] + [(5, t) for t in texts[5:7]] + [(7, texts[7])])
    got = collections.Counter((x.doc_id, x.text) for x in simhash_similarity.near_dedup(df).collect())
    one = set(got - want)  # of two similar texts with one doc_id either stays
    assert not want - got and len(one) == 1 and one <= {(5, texts[4]), (5, texts[4] + " more")}
    items = spark.createDataFrame([(1, " ".join(texts[1].split()[5:40])), (2, texts[5])], "item_id long, text string")
    clean = decontamination.decontaminated(df, items)
    assert clean.columns == df.columns
    assert collections.Counter((x.doc_id, x.text) for x in clean.collect()) == collections.Counter((i, t) for i, t, _ in table if t not in (texts[1], texts[5]))


def _names_in(module):
    """Every name in quotes in the sources of an operator and of what they share."""
    import pathlib

    folder = pathlib.Path(module.__file__).parent
    text = "".join((folder / f).read_text() for f in (pathlib.Path(module.__file__).name, "common.py", "graph.py"))
    return sorted(set(re.findall(r"[\"'](_{0,2}[a-z][a-z0-9_]{0,20})[\"']", text)) - {"doc_id", "text"})


KEEPING = [
    (lambda d, t: decontamination.decontaminated(d, t), decontamination, ()),
    (lambda d, t: simhash_similarity.near_dedup(d), simhash_similarity, ()),
    (lambda d, t: substring_dedup.substring_dedup(d), substring_dedup, ("n_words", "n_removed", "kept_sha256", "removed_spans")),
    (lambda d, t: sharding.bounded_ring(d), sharding, ("size", "text_crc32", "shard", "slot", "text")),
    (lambda d, t: quality_rules.weak_supervision(d), quality_rules, (*quality_rules.FEATURES, "base_failed", "quality", "kept", "text")),
    (lambda d, t: quality_rules.kept_documents(d), quality_rules, ()),
]


@pytest.mark.parametrize("k", range(len(KEEPING)))
def test_columns_named_like_internal_ones(spark, docs, k):
    """Every name in an operator's source as a column: kept with its values, or replaced where the operator adds it."""
    from pyspark.sql import functions as F

    run, module, added = KEEPING[k]
    names = _names_in(module)
    assert len(names) > 15
    items = spark.createDataFrame([(1, rows()[1][1])], "item_id long, text string")
    plain = docs.select("doc_id", "text")
    got = run(plain.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in names)), items)
    own = [c for c in names if c not in added]
    assert [c for c in got.columns if c in own] == own and set(got.columns) >= set(own)
    table = got.select("doc_id", *own).collect()
    assert collections.Counter(r.doc_id for r in table) == collections.Counter(r.doc_id for r in run(plain, items).select("doc_id").collect())
    assert (table or run is KEEPING[5][0]) and all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in table for c in own)


def test_shards_do_not_depend_on_files(spark, docs):
    """The same rows in 3 and in 50 parts, and in another order, get the same shards and slots."""
    place = lambda d: collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.bounded_ring(d, shards=7, vnodes=16).collect())
    assert place(docs.repartition(3)) == place(docs.repartition(50, "text")) == place(docs.orderBy("text").coalesce(1))


def test_windows_need_both_hashes():
    """Entries are grouped only where both hashes agree."""
    from dealflow.llm import common

    k, o, v = np.array([5, 5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64), np.array([9, 4, 3, 8, 6])
    least, order, first = common.least_of(k, o, v)
    assert least.tolist() == [3, 4, 3, 8, 4] and len(first) == 3
    assert common.least_of(k[:0], o[:0], v[:0])[0].tolist() == []
