"""Substring search that reads only the parts of a table that can hold the text.

Rows are written in parts along the searched columns, so that alike texts lie together, with the character trigrams that
occur in each column of each part. A text can only be in a column that has all of its trigrams, so a
search looks those up, reads the parts that are left, and tests their rows exactly.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import facets, search_any

PART = "part"
LENGTH = 3


class Hits(NamedTuple):
    """Matching rows, and how many parts were read of how many."""

    rows: DataFrame
    parts_read: int
    parts: int


def _trigrams(text: Column) -> Column:
    """Distinct trigrams of a text, empty for shorter ones; NULL has none."""
    count = F.length(text) - (LENGTH - 1)
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(LENGTH)))
    return F.array_distinct(F.when(count >= 1, grams).otherwise(F.array().cast("array<string>")))


def build(df: DataFrame, columns: list[str], path: str, parts: int = 256) -> None:
    """Write a table and its trigrams for `search`. The number of parts bounds what a search holds on the driver."""
    numbered = df.repartitionByRange(parts, *columns).withColumn(PART, F.spark_partition_id())
    numbered.write.partitionBy(PART).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    each = [rows.select(PART, F.lit(c).alias("column"), F.explode(_trigrams(F.lower(F.col(c)))).alias("gram")) for c in columns]
    grams = reduce(DataFrame.unionByName, each).distinct()
    grams.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/trigrams")


def search(spark: SparkSession, path: str, columns: list[str], text: str | None, chosen: dict[str, list] | None = None) -> Hits:
    """The rows of `filters.search_any` over the table that `build` wrote. Texts of less than a trigram skip nothing."""
    rows = spark.read.parquet(f"{path}/rows")
    every = sorted(r[0] for r in rows.select(PART).distinct().collect())
    needle = (text or "").strip().lower()
    wanted = sorted({needle[i : i + LENGTH] for i in range(len(needle) - LENGTH + 1)})
    if wanted:
        grams = spark.read.parquet(f"{path}/trigrams").where(F.col("gram").isin(wanted) & F.col("column").isin(columns))
        full = grams.groupBy(PART, "column").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
        left = sorted(r[0] for r in full.select(PART).distinct().collect())
    else:
        left = every
    kept = rows.where(F.col(PART).isin(left)).drop(PART)
    return Hits(search_any(facets(kept, chosen or {}), columns, needle), len(left), len(every))
