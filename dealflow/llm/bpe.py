"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

In a BPE encoding each prefix of a piece has a unique last token. For every prefix in turn, an automaton over
the vocabulary finds the tokens that are suffixes of it; the one whose left neighbour, the stored last token of
the prefix before it, is compatible with it is stored. Two tokens are compatible if merging their joint text
gives just these two; that is tested by undoing their merges from the latest on and asking whether a merge
across the border would have come first. Following the stored tokens back from the end gives the ids.

Texts meet the DP piece by piece, as the tokenizer's file says: special tokens are cut out, white space parts
words, words are composed (NFC), lower-cased character by character and cut by the pattern in the file, and the
last symbol of a piece carries the word end. Words repeat, so each task keeps a bounded store of encoded words.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: White space of Unicode, which parts words; str.split() would also part at U+001C to U+001F.
_WORD = regex.compile("[^\t-\r \x85\xa0  -     　]+")
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: A symbol that ends a word is its byte's character moved up by this.
_END = 0x1000
#: Entries of a store of encoded words; there are two.
STORE = 100_000
_FIRST, _SECOND = itemgetter(0), itemgetter(1)


def split_words(text: str) -> list[str]:
    return _WORD.findall(text) if any(s in text for s in _SEPARATORS) else text.split()


def byte_characters() -> list[str]:
    """The character of each byte in byte-level vocabularies: printable ones stand for themselves, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(0x100 + rest.index(b)) for b in range(256)]


class WordPieces:
    """How a tokenizer file with NFC, lower case, a pattern and byte level cuts words before its model sees them."""

    def __init__(self, spec: dict):
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.inner = dict(enumerate(byte_characters()))

    def __call__(self, word: str) -> list[str]:
        """The pieces of a word, in characters that stand for bytes."""
        if word.isascii():
            text = word.lower()
            if text.isalpha():
                return [text]
        else:
            text = unicodedata.normalize("NFC", word)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        pieces = self.pattern.findall(text)
        if text.isascii() and text.isprintable():
            return pieces
        return [p.encode().decode("latin-1").translate(self.inner) for p in pieces]


class Store(dict):
    """Values of keys, made on demand; a full store becomes the older one, which is looked up second."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class PrefixBPE:
    """A tokenizer file of the library's format with BPE, byte level and a word-end suffix."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.cut_word = WordPieces(spec)
        self.special = self.cut_word.special
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.name = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        inside = lambda t: t[: -len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + _END) if t.endswith(suffix) and len(t) > len(suffix) else t
        vocab = {inside(t): i for t, i in model["vocab"].items()}
        self.length = {i: len(t) for t, i in vocab.items()}
        self.merge, self.parts, self.rank = {}, {}, {}
        for rank, (a, b) in enumerate(model["merges"]):
            a, b = inside(a), inside(b)
            whole = vocab[a + b]
            self.merge[vocab[a] << 32 | vocab[b]] = rank
            self.parts[whole], self.rank[whole] = (vocab[a], vocab[b]), rank
        self.known: dict[int, bool] = {}
        self.words = Store(self._word, STORE)
        whole_ones = set()
        self.matcher = ahocorasick.Automaton()
        for t, i in sorted(vocab.items(), key=lambda x: self.rank.get(x[1], -1)):
            parts = self.parts.get(i)
            if parts is None or (parts[0] in whole_ones and parts[1] in whole_ones and self._apart(*parts, self.rank[i])):
                whole_ones.add(i)  # merging its own text gives this token
                self.matcher.add_word(t, (i, len(t)))
        self.matcher.make_automaton()

    def _apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge across the border of a and b comes before both are complete, or before the given rank."""
        merge, rank, limit = self.merge, self.rank, before
        while True:
            if merge.get(a << 32 | b, limit) < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # a was merged last: until then its right part stood at the border
                limit, a = ra, self.parts[a][1]
            else:  # of equal merges the left one comes first, so one across the border, too
                limit, b = rb + 1, self.parts[b][0]

    def encode_piece(self, symbols: str) -> list[int]:
        last = [-1] * (len(symbols) + 1)
        known = self.known
        for end, (token, length) in self.matcher.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                pair = last[start] << 32 | token
                ok = known.get(pair)
                if ok is None:
                    if len(known) > 2 * STORE:
                        known.clear()
                    ok = known[pair] = self._apart(last[start], token)
                if not ok:
                    continue
            last[end] = token
        out, end = [], len(symbols)
        while end:
            out.append(last[end])
            end -= self.length[last[end]]
        return out[::-1]

    def encode_word(self, word: str) -> list[int]:
        out = []
        for piece in self.cut_word(word):
            out += self.encode_piece(piece[:-1] + chr(ord(piece[-1]) + _END))
        return out

    def _word(self, word: str) -> tuple[bytes, str]:
        """Ids as 32-bit numbers, and their decoded text."""
        ids = self.encode_word(word)
        return array("I", ids).tobytes(), self.decode(ids)

    def encode(self, text: str) -> tuple[bytes, str, int]:
        """Of a whole text: ids as bytes, decoded text, number of ids."""
        if self.cut and self.cut.search(text):
            parts, at = [], 0
            for m in self.cut.finditer(text):
                parts += [*map(self.words.__getitem__, split_words(text[at : m.start()])), (array("I", [self.special[m[0]]]).tobytes(), m[0])]
                at = m.end()
            parts += map(self.words.__getitem__, split_words(text[at:]))
        else:
            parts = list(map(self.words.__getitem__, split_words(text)))
        ids = b"".join(map(_FIRST, parts))
        return ids, " ".join(filter(None, map(_SECOND, parts))), len(ids) // 4

    def decode(self, ids) -> str:
        """The file names no decoder, so tokens are joined by a space, special ones included."""
        return " ".join(map(self.name.__getitem__, ids))


_LOADED: dict[int, PrefixBPE] = {}


def loaded(file: bytes) -> PrefixBPE:
    key = hash(file)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PrefixBPE(file)
    return _LOADED[key]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with token_ids (array<int>) and decoded if with_ids.

    tokenizer: a file of the tokenizers library, read on the driver (its size is fixed, a few MB) and sent to
    the executors once. A null text counts as empty, and an empty one has no ids. Each row is encoded alone and whole,
    a very long text too, so repeated rows, ties, null doc_ids and extra columns do not matter. An empty table gives an
    empty result.
    """
    with open(tokenizer, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = loaded(file.value)
        for batch in batches:
            rows = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            cols = [
                batch.column(0),
                pa.array([n for _, _, n in rows], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b, _, _ in rows], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t, _ in rows], pa.string()),
            ]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b, _, _ in rows], pa.list_(pa.int32())), pa.array([t for _, t, _ in rows], pa.string())]
                names += ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(C.lean_batches(run), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_documents() of all documents; see there for nulls, blanks, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, default_tokenizer(), with_ids=False)
