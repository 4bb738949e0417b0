"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive, so they are kept as sums of signed deltas. A batch of
changes holds rows to insert, to delete, or to revise (the old count goes, the new one comes); each becomes signed
rows, which are summed before anything is stored. A batch is written whole to a folder of its own, and then committed
by a marker named by its id, which names the folder. The marker is whole before it takes its name by a rename that
fails where the name is taken.
So of several runs of one batch one is counted, and replaying a batch after a failure, in any order, changes
nothing. Totals read the committed sums only, never the documents.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KEYS = ("source", "lang", "tokenizer")
WORD = r"[^\x20\x09-\x0D]+"
#: Version 2 parts ASCII punctuation from words, one token each.
PART = r"[!-/:-@\[-`{-~]|[^\x20\x09-\x0D!-/:-@\[-`{-~]+"
VERSIONS = {"words-1": WORD, "words-2": PART}


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) from (op, source, lang, tokenizer, old_tokens, new_tokens[, times]).

    op: insert (new_tokens counts), delete (old_tokens is taken back), revise (both). times: the number of documents
    that a row stands for, 1 without that column. Null counts are 0, null keys are keys of their own, and any other op
    is an error.
    """
    times = F.coalesce("times", F.lit(0)) if "times" in changes.columns else F.lit(1)
    op, old, new = F.col("op"), F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))).cast("int"))
    tokens = F.when(op == "insert", new).when(op == "delete", -old).otherwise(new - old)
    return changes.select(*KEYS, (docs * times).cast("long").alias("docs"), (tokens * times).cast("long").alias("tokens"))


class TokenRollup:
    """Totals in a folder that driver and executors share."""

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _folders(self) -> dict[str, str]:
        """The folder of each committed batch, as the markers name them."""
        marks = [f.getPath() for f in self._fs.listStatus(self._path(self.folder)) if f.getPath().getName().startswith("batch=")]
        named = {m.getName()[6:]: self._read(m) for m in marks}
        return {b: f"{self.folder}/{d}" for b, d in named.items() if d}

    def _read(self, mark) -> str:
        at = self._fs.open(mark)
        try:
            return bytes(at.readAllBytes()).decode()
        finally:
            at.close()

    def committed(self) -> list[str]:
        """Ids of the batches that totals hold."""
        return sorted(self._folders())

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits the changes under batch_id; False, and nothing done, where that batch is committed already."""
        if batch_id in self._folders():
            return False
        own = f"data-{batch_id}-{uuid.uuid4().hex}"
        signed(changes).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.folder}/{own}")
        if not self._commit(batch_id, own):  # another run was first
            self._fs.delete(self._path(f"{self.folder}/{own}"), True)
            return False
        return True

    def _commit(self, batch_id: str, own: str) -> bool:
        """The marker is written whole under a name that nobody reads, and renamed to its own unless that is taken."""
        waiting, mark = self._path(f"{self.folder}/.{own}"), self._path(f"{self.folder}/batch={batch_id}")
        out = self._fs.create(waiting, True)
        out.write(bytearray(own.encode()))
        out.close()
        if self._fs.exists(mark) and not self._read(mark):
            self._fs.delete(mark, False)  # markers are never empty here: one that is was left by a run that died, of the time when they were filled in place
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(mark.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(waiting, mark, self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(waiting, False)
            return False
        return True

    def apply_stream(self, changes: DataFrame, checkpoint: str, name: str):
        """A streaming query that commits each micro-batch under its epoch; a replayed epoch changes nothing."""
        return changes.writeStream.foreachBatch(lambda df, epoch: self.apply(f"{name}-{epoch}", df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def deltas(self) -> DataFrame:
        batches = list(self._folders().values())
        return self.spark.read.schema(self.SCHEMA).parquet(*batches) if batches else self.spark.createDataFrame([], self.SCHEMA)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of what is left; groups without documents and tokens are gone."""
        out = self.deltas().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.where("docs <> 0 OR tokens <> 0")

    def rollup(self) -> DataFrame:
        """Totals at every level: all, by source, by source and language, and by all three, for each tokenizer.

        level: 0 for tokenizer alone, 1 with source, 2 with language as well; keys of coarser levels are null.
        """
        t = self.totals()
        out = t.groupingSets([["tokenizer"], ["tokenizer", "source"], ["tokenizer", "source", "lang"]], "tokenizer", "source", "lang")
        out = out.agg((2 - F.bit_count(F.grouping_id())).cast("int").alias("level"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.select("level", *KEYS, "docs", "tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, deletes exact copies of a smaller doc_id, and revises those with repeated lines.

    The delete batch is sent twice, as after a failure; the second one is not counted. The revised text keeps the
    first of equal lines. Null texts count as empty, and a null doc_id is larger than every other; of rows that repeat
    doc_id and text one stays. An empty table has no totals. A very long text is one row, counted whole.

    Copies are not joined: equal texts of one source and language become one row with their number, combined before
    the shuffle, so a text that a third of all documents share is a row a task; the row that stays is the least of a
    text's rows.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    docs = docs.withColumns({"__sha": F.sha2(text, 256), "__lines": F.array_join(F.array_distinct(lines), "\n")})
    before = F.array(*(F.regexp_count(text, F.lit(p)).cast("long") for p in VERSIONS.values()))
    after = F.when(F.length("__lines") < F.length(text), F.array(*(F.regexp_count("__lines", F.lit(p)).cast("long") for p in VERSIONS.values())))
    docs = docs.select("doc_id", "source", "lang", "__sha", before.alias("__before"), after.alias("__after"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.struct("source", "lang").alias("key"))
    groups = docs.groupBy("__sha", "source", "lang").agg(F.count("*").alias("times"), F.min(place).alias("__least"), F.first("__before").alias("__before"), F.first("__after").alias("__after"))
    # Each text is read once; the counts go to the shared folder and feed all three batches.
    groups = C.saved(groups)
    first = groups.groupBy("__sha").agg(F.min("__least").alias("__first"))
    groups = C.saved(groups.join(first, "__sha").withColumn("__stays", F.col("__least").eqNullSafe(F.col("__first")).cast("long")))
    names = F.array(*map(F.lit, VERSIONS))
    rows = groups.select("source", "lang", "times", "__stays", F.inline(F.arrays_zip(names.alias("tokenizer"), F.col("__before").alias("old"), F.coalesce("__after", "__before").alias("new"))))
    rows = rows.toDF("source", "lang", "times", "stays", "tokenizer", "old", "new")
    change = lambda op, d, old, new, times: d.select(F.lit(op).alias("op"), *KEYS, F.expr(old).cast("long").alias("old_tokens"), F.expr(new).cast("long").alias("new_tokens"), F.expr(times).alias("times"))
    rollup = TokenRollup(spark, C.shared_path(spark, "token-counts"))
    rollup.apply("1-load", change("insert", rows, "null", "old", "times"))
    copies = change("delete", rows.where("times > stays"), "old", "null", "times - stays")
    rollup.apply("2-copies", copies)
    rollup.apply("3-lines", change("revise", rows.where("stays = 1 AND old <> new"), "old", "new", "stays"))
    rollup.apply("2-copies", copies)
    return rollup.rollup()


SQL = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS r FROM documents),
l AS (SELECT doc_id, source, lang, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d WHERE r = 1),
u AS (SELECT doc_id, source, lang, x, min(i) AS i FROM l GROUP BY doc_id, source, lang, x),
k AS (SELECT doc_id, source, lang, string_agg(x, chr(10) ORDER BY i) AS t FROM u GROUP BY doc_id, source, lang),
c AS (SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM k
      UNION ALL SELECT source, lang, 'words-2', len(regexp_extract_all(t, '[!-/:-@\[-`{-~]|[^\x20\x09-\x0D!-/:-@\[-`{-~]+')) FROM k)
SELECT CASE WHEN grouping(source) = 1 THEN 0 WHEN grouping(lang) = 1 THEN 1 ELSE 2 END::INTEGER AS level, source, lang, tokenizer, count(*) AS docs, sum(n)::BIGINT AS tokens
FROM c GROUP BY GROUPING SETS ((tokenizer), (tokenizer, source), (tokenizer, source, lang))
"""
