"""The corpus operators over the given tables: one query per operator, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, forest, html, linededup, lm, pii, quality, runs, simhash, tokenstore, toxicity
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line repeats, exactly or up to one word."""
    found = linededup.dedup(table(spark, sf_dir, "documents"))
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    return found.select("doc_id", "text", lines.alias("n_kept"), "n_exact", "n_near")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, base and model."""
    return lm.score(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    found = quality.apply(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, percent=5)
    return found.drop("text_hash")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document, as read back from token files."""
    return tokenstore.stored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    return forest.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, the tail of a tenth of them made periodic."""
    return runs.digests(runs.find(runs.planted(table(spark, sf_dir, "documents"))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that set it apart."""
    return divergence.divergences(table(spark, sf_dir, "documents"), least_docs=3, most=200)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_extract": op3_html_extract,
    "op4_lm_score": op4_lm_score,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_token_store": op9_token_store,
    "op10_toxicity": op10_toxicity,
    "op11_minhash_forest": op11_minhash_forest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op6_quality": quality.oracle_sql(),
    "op11_minhash_forest": forest.oracle_sql(),
    "op12_periodic_runs": runs.oracle_sql(),
    "op13_source_divergence": divergence.oracle_sql(),
}
