"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, linededup, simhash, toxicity
from tidemark.llm.common import table
from tidemark.session import scratch_path, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; other texts of the same id, or without one, stay."""
    found = toxicity.classify(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rejected = found.filter("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(rejected, docs.doc_id.eqNullSafe(rejected["_id"]) & (F.xxhash64(docs.text) == rejected["_hash"]), "left_anti")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go, and `n_chars` follows the text; every document stays."""
    kept = linededup.dedup(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_exact") + F.col("n_near") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(
        docs.columns
    )


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest id stays; unrelated texts of one id, or without one, all do."""
    return simhash.keep_first(docs, shingle=4, distance=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), window=13, percent=5)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left and the digest of their decoded bytes: doc_id, n_tokens, ids, decoded_sha256."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # written in between, or every task would have a Python worker for each half
    ids = staged(bpe.encode(docs, path, public_tokenizers.PATTERN), "ids")
    found = bpe.decode(ids, path)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: Learned scores, edit distances and tokenisation are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
