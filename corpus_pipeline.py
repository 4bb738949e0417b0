"""A corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs; all but the last return the columns of documents. The last returns doc_id, n_tokens and digests of the ids
and of the decoded text.

Every stage takes nulls in any column, empty and very long texts (whole, in one task), repeated rows, empty tables
(which give empty ones) and further columns of any name (which stay, but for the last stage); what becomes of
nulls, ties and repeats stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.llm import bpe, common, decontamination, quality_rules, simhash_similarity, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep.

    Null and blank texts have fewer than 50 words and go. Repeated rows share one verdict; doc_id plays no part.
    """
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar at 0.8 or more.

    The least doc_id stays, a null one only where its group has no other; ties go by a hash of the text. Null and blank
    texts are one group, and of rows that repeat doc_id and text one stays.
    """
    return simhash_similarity.near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages repeated from smaller doc_ids; ones left without a word go.

    Null and blank texts have no word to lose and stay. A null doc_id is larger than every other; rows of equal doc_ids do
    not cut each other, so repeated rows stay alike. n_chars follows the text where words were cut.
    """
    out = substring_dedup.substring_dedup(docs)
    out = out.where("n_removed < n_words OR n_words = 0")
    changed = F.col("n_removed") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of benchmark.

    Null and blank texts contain none. Each row is judged by its own text, so null and repeated doc_ids and repeated rows
    keep their clean rows. An empty benchmark keeps all.
    """
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and their decoding, as digests: a row for each row, null texts as empty ones, in no order."""
    return bpe.encode_documents(docs, bpe.default_tokenizer(), with_ids=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL can express neither the iteration of the rules nor BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = common.shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
