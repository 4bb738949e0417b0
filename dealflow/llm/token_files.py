"""Token ids as flat binary files.

A folder holds, for each partition p in ascending doc_id order, ``tokens-p.bin`` (unsigned 16-bit ids where the
vocabulary fits, else 32-bit, little-endian), ``offsets-p.bin`` (64-bit: where each document starts in the file,
and the file's length) and ``ids-p.bin`` (the doc_ids, 64-bit). ``index.json`` lists partitions with their sizes
and the bases that prefix sums of the sizes give, so that any document's place in the whole is base + offset.

Each partition is written by one task under a name of its attempt and then renamed, so that a lost executor
or a second attempt leaves one whole file with the same content. Files are read memory-mapped where the folder
is local, and through the file system of its URI elsewhere.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .bpe import Store, WordPieces, default_tokenizer, split_words

END_ID, STORE = 2, 400_000
NULL_ID = np.iinfo(np.int64).min


class WordEncoder:
    """The tokenizers library's ids of texts; words repeat, so a bounded store holds those of words seen before.

    Words are cut into pieces as the tokenizer file says (see WordPieces) and the library's model encodes the pieces,
    which saves its bookkeeping of places in the text. Texts with special tokens, and all texts where the file
    has other steps, go through the library whole. The tests compare with whole texts.
    """

    def __init__(self, file: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.code = self.tokenizer.model, "H" if dtype == "<u2" else "I"
        spec = json.loads(file)
        self.cut_word = WordPieces(spec) if _steps(spec) == KNOWN_STEPS else None
        self.words = Store(self._word, STORE)

    def _word(self, word: str) -> bytes:
        return array(self.code, [t.id for piece in self.cut_word(word) for t in self.model.tokenize(piece)]).tobytes()

    def encode(self, text: str) -> bytes:
        if self.cut_word is None or any(s in text for s in self.cut_word.special):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, split_words(text)))


#: The steps of a tokenizer file that WordPieces takes.
KNOWN_STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel", "BPE"]


def _steps(spec: dict) -> list[str]:
    steps = [*((spec.get("normalizer") or {}).get("normalizers") or []), *((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [])]
    return [x["type"] for x in steps] + [spec["model"]["type"]]


_LOADED: dict = {}


def _encoder(file: str, dtype: str) -> WordEncoder:
    key = hash(file), dtype
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordEncoder(file, dtype)
    return _LOADED[key]


def _open(folder: str):
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path.rstrip("/")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> dict:
    """Encodes every text, appends end_id, and writes the folder (a URI that driver and executors share); returns the index.

    A null text counts as empty and holds the end id alone. A null doc_id comes first; rows of equal doc_id are
    ordered by their text, and their ranges are parted by it, too. A very long text is one row of one task. An empty
    table writes an index without documents. Other columns are not written. parts: the number of files, by default
    from the size of the input; it changes no id and no place.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    from tokenizers import Tokenizer

    top = Tokenizer.from_str(text).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(top - 1, end_id) < 1 << 16 else "<u4"
    file = spark.sparkContext.broadcast(text)
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    end = np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def run(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        encoder = _encoder(file.value, dtype)
        sizes, doc_ids = [np.zeros(1, np.int64)], []
        with fs.open_output_stream(f"{path}/.tokens-{part:06d}-{attempt}") as out:
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    rows = batch.slice(i, 512)
                    got = [encoder.encode(t or "") for t in rows.column(1).to_pylist()]
                    out.write(end.join([*got, b""]))
                    sizes.append(np.array([len(x) // width + 1 for x in got], np.int64))
                    doc_ids.append(np.asarray(rows.column(0).fill_null(NULL_ID)))
        offsets = np.cumsum(np.concatenate(sizes))
        for name, data in (("offsets", offsets.astype("<u8")), ("ids", np.concatenate([*doc_ids, np.zeros(0, np.int64)]).astype("<i8"))):
            with fs.open_output_stream(f"{path}/.{name}-{part:06d}-{attempt}") as out:
                out.write(data.tobytes())
        for name in ("tokens", "offsets", "ids"):
            fs.move(f"{path}/.{name}-{part:06d}-{attempt}", f"{path}/{name}-{part:06d}.bin")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([len(offsets) - 1], pa.int64()), "tokens": pa.array([int(offsets[-1])], pa.int64())})

    n = parts or max(C.chunk_count(C.text_bytes(docs, text_col), spark), 1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, F.col("id"), F.substring("text", 1, 32)).sortWithinPartitions("id", "text")
    written = sorted(rows.mapInArrow(run, "part int, docs long, tokens long").collect())  # one row a partition
    index, doc_base, base = [], 0, 0
    for r in written:
        index.append({"part": r["part"], "docs": r["docs"], "tokens": r["tokens"], "doc_base": doc_base, "base": base})
        doc_base, base = doc_base + r["docs"], base + r["tokens"]
    index = {"dtype": dtype, "docs": doc_base, "tokens": base, "parts": index}
    with fs.open_output_stream(f"{path}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), with ids (array<int>) if with_ids, from the files; one task a partition file.

    start counts the ids of all documents before, ids_crc32 is of the ids as little-endian 32-bit numbers.
    """
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/index.json") as f:
        index = json.loads(f.read())
    dtype, local = index["dtype"], isinstance(fs, pafs.LocalFileSystem)

    def load(fs, name, kind):
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(name, kind, "r") if os.path.getsize(name) else np.zeros(0, kind)
        with fs.open_input_file(name) as f:
            return np.frombuffer(f.read(), kind)

    def run(batches):
        fs, path = _open(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                tokens, offsets, doc_ids = (load(fs, f"{path}/{n}-{part:06d}.bin", k) for n, k in (("tokens", dtype), ("offsets", "<u8"), ("ids", "<i8")))
                for a in range(0, len(doc_ids), 2048):
                    off = offsets[a : a + 2049].astype(np.int64)
                    ids = np.array(doc_ids[a : a + 2048])
                    flat = tokens[off[0] : off[-1]].astype("<u4")
                    cut = off - off[0]
                    cols = {
                        "doc_id": pa.array(ids, mask=ids == NULL_ID),
                        "start": pa.array(off[:-1] + base),
                        "n_tokens": pa.array(np.diff(off)),
                        "ids_crc32": pa.array([zlib.crc32(flat[s:e]) for s, e in zip(cut[:-1], cut[1:])], pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(cols)

    parts = [(p["part"], p["base"]) for p in index["parts"] if p["docs"]]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    table = spark.createDataFrame(parts, "part int, base long")
    return C.deal(table, len(index["parts"]) or 1, "part").mapInArrow(run, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written and read back; see write_tokens() for nulls, blanks, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = C.shared_path(spark, "tokens")
    write_tokens(docs, folder, default_tokenizer())
    return read_tokens(spark, folder, with_ids=False)
