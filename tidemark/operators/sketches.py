"""Distinct counts that merge: sketches per group, stored, and combined over any range of groups later.

Exact distinct counts of a range need every value of it again. A sketch of `precision` bits needs a few kilobytes per
group, and the union of sketches is the sketch of the union, so weeks, months or any filter come from the stored
rows alone. The relative standard error is about 1.04 / sqrt(2 ** precision).
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 14


def relative_error(precision: int = PRECISION) -> float:
    """The standard error of an estimate, as a share of the count."""
    return 1.04 / sqrt(2**precision)


def distinct_sketches(df: DataFrame, keys: list[str | Column], columns: dict[str, str], precision: int = PRECISION) -> DataFrame:
    """(keys, one sketch per column): `columns` gives the sketch's name and the column whose values it holds; merges before
    the shuffle. NULL is no value; a group with none has an empty sketch."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(precision)).alias(name) for name, c in columns.items()])


def merge_sketches(sketches: DataFrame, keys: list[str | Column], names: list[str]) -> DataFrame:
    """(keys, one sketch per name): the union of stored sketches, with the same precision."""
    return sketches.groupBy(*keys).agg(*[F.hll_union_agg(n).alias(n) for n in names])


def estimates(sketches: DataFrame, names: list[str]) -> DataFrame:
    """The sketches replaced by the number of distinct values that each stands for."""
    return sketches.withColumns({n: F.hll_sketch_estimate(n) for n in names})


def distinct_counts(df: DataFrame, keys: list[str | Column], columns: dict[str, str], exact: bool = True, precision: int = PRECISION) -> DataFrame:
    """(keys, one count per name), exact or estimated in one pass without expanding rows per column."""
    if exact:
        return df.groupBy(*keys).agg(*[F.count_distinct(c).alias(name) for name, c in columns.items()])
    return estimates(distinct_sketches(df, keys, columns, precision), list(columns))
