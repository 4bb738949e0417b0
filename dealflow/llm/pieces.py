"""SentencePiece encoding and decoding through a table of distinct chunks.

The model marks each space, and no piece of it holds a marker after another character (checked when it is loaded). So a
text falls apart before each run of markers, no merge crosses such a border, and each marked word has one segmentation
wherever it stands. Documents travel once, as compressed packs dealt to chunks. Each chunk sends its distinct marked
words to buckets by their hash; a bucket holds each word once, whatever number of chunks ask for it, segments it and
answers in the order of the question. The chunk joins the ids back by position: its documents are looked up word by word
in the answered table. A newline that is part of no piece parts words, too, so that ends and starts of lines do not make
words of their own.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

MARK = "▁"
CHUNK_BYTES = 32 << 20
#: Chunks whose distinct words one bucket answers.
CHUNKS_A_BUCKET = 4
#: Longer words are merged with a heap.
LONG = 40
codecs.register_error("one-by-one", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """A BPE model with byte fallback and a dummy prefix, as the library's file holds it, and no other normalization.

    The file is read by the library; words are segmented and ids decoded here.
    """

    def __init__(self, file: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(file)
        norm, kind = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not spec.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalization")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece crosses a marker, so words cannot be segmented alone")
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kind.NORMAL}
        self.byte = [0] * 256
        self.text: list[bytes] = []
        for i, p in enumerate(spec.pieces):
            if p.type == kind.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
            self.text.append(bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else b"" if p.type == kind.CONTROL else " ⁇ ".encode() if p.type == kind.UNKNOWN else p.piece.replace(MARK, " ").encode())
        self.lines = not any("\n" in p for p in self.id)
        self.width = "H" if len(spec.pieces) <= 1 << 16 else "I"
        self._parts = re.compile(f"\n[^{MARK}\n]*|{MARK}+[^{MARK}\n]*" if self.lines else f"{MARK}+[^{MARK}]*")

    def words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first marker; words that follow a newline start with it and have none."""
        if not text:
            return []
        spaced = text.replace("\n", " \n") if self.lines else text
        if "  " in spaced or spaced[0] == " " or spaced[-1] == " " or MARK in text:
            return [x if x[0] == "\n" else x[1:] for x in self._parts.findall(MARK + text.replace(" ", MARK))]
        return spaced.split(" ")

    def segment(self, word: str) -> bytes:
        """The ids of one of words(), as numbers of ``width``."""
        symbols = list(word) if self.lines and word[:1] == "\n" else [MARK, *word]
        symbols = self._merged(symbols) if len(symbols) < LONG else self._merged_long(symbols)
        out = array(self.width)
        for s in symbols:
            i = self.id.get(s)
            if i is None:
                out.extend(self.byte[b] for b in s.encode())
            else:
                out.append(i)
        return out.tobytes()

    def _merged(self, s: list[str]) -> list[str]:
        """The pair with the best score is merged, the leftmost of equals, until none is a piece."""
        get = self.score.get
        pair = [get(a + b) for a, b in zip(s, s[1:])]
        while True:
            best = max((x for x in pair if x is not None), default=None)
            if best is None:
                return s
            i = pair.index(best)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = get(s[i - 1] + s[i])
            if i < len(pair):
                pair[i] = get(s[i] + s[i + 1])

    def _merged_long(self, s: list[str]) -> list[str]:
        """The same with a heap over linked symbols, for words of any length."""
        n, get = len(s), self.score.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-x, i, a, b) for i, (a, b) in enumerate(zip(s, s[1:])) if (x := get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j], right[i] = a + b, "", right[j]
            if right[j] < n:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (x := get(s[p] + s[q])) is not None:
                    heapq.heappush(heap, (-x, p, s[p], s[q]))
        return [x for x in s if x]

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in np.frombuffer(self.segment(w), self.width).tolist()]

    def decode(self, ids) -> str:
        """Pieces joined, markers as spaces without the dummy prefix; each byte that is no UTF-8 becomes U+FFFD."""
        out = b"".join(map(self.text.__getitem__, ids))
        marked = out[:1] == b" " and ids[0] not in self.byte  # the byte of a space is no marker
        return (out[1:] if marked else out).decode("utf-8", "one-by-one")


_LOADED: dict[int, PieceModel] = {}


def loaded(file: bytes) -> PieceModel:
    key = hash(file)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(file)
    return _LOADED[key]


def _by_bucket(words: set[str], n: int) -> list[list[str]]:
    """Words in order, by the bucket of their hash."""
    out: list[list[str]] = [[] for _ in range(n)]
    for w in sorted(words):
        out[zlib.crc32(w.encode()) % n].append(w)
    return out


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, chunks: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with token_ids (array<int>) and decoded if with_ids.

    model: a file of the sentencepiece library, read on the driver (its size is fixed) and sent to the executors once.
    ids_sha256 is of decimal ids joined by commas. A null text counts as empty, and an empty one has no ids. Every row gives
    a row: repeated rows, ties and null ids do not matter, as ids and texts travel together; a very long text is a pack
    of its own, and a very long word is merged with a heap. Further columns are left out whatever their names. An
    empty table gives an empty result. chunks: see common.
    """
    spark = docs.sparkSession
    with open(model, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    n = chunks or C.chunk_count(C.text_bytes(docs, text_col), spark, CHUNK_BYTES)
    buckets = max(1, -(-n // CHUNKS_A_BUCKET))
    x = C.packs(docs, n, [id_col, text_col], text_col)

    def ask(rows: pa.Table) -> pa.Table:
        m, words = loaded(file.value), set()
        for t in C.unpacked_docs(rows)["c1"]:
            words.update(m.words(t.as_py() or ""))
        asked = [(b, C.zipped(pa.table({"w": pa.array(w, pa.string())}))) for b, w in enumerate(_by_bucket(words, buckets)) if w]
        return pa.table({C.BUCKET: pa.array([b for b, _ in asked], pa.int32()), C.CHUNK: pa.array([rows[C.CHUNK][0].as_py()] * len(asked), pa.int32()), "words": pa.array([w for _, w in asked], pa.binary())})

    def answer(rows: pa.Table) -> pa.Table:
        m, table, out = loaded(file.value), {}, []
        for blob in rows["words"]:
            words = C.unzipped(blob.as_py())["w"].to_pylist()
            for w in words:
                if w not in table:
                    table[w] = m.segment(w)
            out.append(C.zipped(pa.table({"ids": pa.array([table[w] for w in words], pa.binary())})))
        return pa.table({C.CHUNK: rows[C.CHUNK], C.BUCKET: rows[C.BUCKET], "ids": pa.array(out, pa.binary())})

    def join(rows: pa.Table, answers: pa.Table) -> pa.Table:
        m = loaded(file.value)
        docs_ = C.unpacked_docs(rows)
        texts, words = docs_["c1"].to_pylist(), set()
        for t in texts:
            words.update(m.words(t or ""))
        asked, ids = _by_bucket(words, buckets), {}
        for b, blob in zip(answers[C.BUCKET].to_pylist(), answers["ids"]):
            ids.update(zip(asked[b], C.unzipped(blob.as_py())["ids"].to_pylist(), strict=True))
        decimal, text = {}, {}
        for w, i in ids.items():
            i = array(m.width, i)
            decimal[w], text[w] = b",".join([b"%d" % k for k in i]), b"".join([m.text[k] for k in i])
        cols = {c: [] for c in ("n_tokens", "ids_sha256", "decoded_sha256")} | ({"token_ids": [], "decoded": []} if with_ids else {})
        for t in texts:
            w = m.words(t or "")
            joined, plain = b",".join(map(decimal.__getitem__, w)), b"".join(map(text.__getitem__, w))
            plain = plain[1:] if plain[:1] == b" " else plain
            cols["n_tokens"].append(joined.count(b",") + 1 if joined else 0)
            cols["ids_sha256"].append(hashlib.sha256(joined).hexdigest())
            cols["decoded_sha256"].append(hashlib.sha256(plain).hexdigest())
            if with_ids:
                cols["token_ids"].append(np.frombuffer(b"".join(map(ids.__getitem__, w)), m.width).astype(np.int32))
                cols["decoded"].append(plain.decode())
        kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "token_ids": pa.list_(pa.int32()), "decoded": pa.string()}
        return pa.table({"id": docs_["c0"]} | {c: pa.array(v, kinds[c]) for c, v in cols.items()})

    asked = x.groupBy(C.CHUNK).applyInArrow(C.lean(ask), f"{C.BUCKET} int, {C.CHUNK} int, words binary")
    answers = C.deal(asked, buckets, C.BUCKET).groupBy(C.BUCKET).applyInArrow(C.lean(answer), f"{C.CHUNK} int, {C.BUCKET} int, ids binary")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * with_ids
    out = x.groupBy(C.CHUNK).cogroup(C.deal(answers, n, C.CHUNK).groupBy(C.CHUNK)).applyInArrow(C.lean_pair(join), schema)
    return out.withColumnRenamed("id", id_col)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_documents() of all documents; see there for nulls, blanks, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, default_model(), with_ids=False)
