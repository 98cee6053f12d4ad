"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the docs of the next. The quality and near-dedup stages drop documents, the
secret stage rewrites texts, the mixing stage orders them, the last encodes them and
keeps that order in mix_pos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, mixing, quality, secrets, simhash
from foliospark.llm.common import table, written
from foliospark.llm.queries import vocabulary

#: Where a row is: number of its partition's file, of the file in it, and of the row, in one number.
PART, FILE = 1 << 43, 1 << 33


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_filter(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id; five words to a shingle, a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets redacted."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture."""
    return mixing.in_mixed_order(docs)


def with_place(docs: DataFrame) -> DataFrame:
    """docs with mix_pos, which follows the order in which they were written: however files are read, their names and rows keep it."""
    if not docs.inputFiles():
        return docs.withColumn("mix_pos", F.monotonically_increasing_id())
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    return docs.withColumn("mix_pos", number(r"^part-(\d+)") * PART + number(r"-c(\d+)") * FILE + F.col("_metadata.row_index"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, place in the mixture, token ids, their number, and whether they decode to the text again."""
    path, pattern = vocabulary()
    out = bpe.encoded(with_place(docs), path, pattern, out="token_ids", keep=["doc_id", "source", "mix_pos"], check="decodes")
    return out.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL expresses neither SimHash components nor merges by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
