"""Aggregation operators. All merge partial results before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hotkeys import HOT_ROWS, Hot, attach, hot_keys


def since(date: str | Column, as_of: Column, days: int) -> Column:
    """Date within the trailing `days` of `as_of`: `days + 1` calendar dates when as_of is included."""
    column = F.col(date) if isinstance(date, str) else date
    return column >= F.date_sub(as_of, days)


def trailing_totals(
    df: DataFrame, keys: list[str], date: str, measures: dict[str, str], days: list[int], as_of: Column
) -> DataFrame:
    """Sums of each measure over several trailing windows in one pass: columns `{alias}_{n}d`."""
    aggs = [
        F.sum(F.when(since(date, as_of, n), F.col(m)).otherwise(0)).alias(f"{alias}_{n}d")
        for m, alias in measures.items()
        for n in days
    ]
    return df.groupBy(*keys).agg(*aggs)


def ratio_of_sums(numerator: Column, denominator: Column, scale: int = 100, digits: int = 1) -> Column:
    """Sum both sides, divide once, NULL on a zero denominator. Never an average of ratios."""
    return F.round(F.lit(scale) * F.try_divide(F.sum(numerator), F.sum(denominator)), digits)


def share_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage of two aggregates, NULL on zero."""
    return F.round(F.lit(100) * F.try_divide(part, whole), digits)


def mean_or(value: Column, default: float) -> Column:
    """Average with a default where no row exists."""
    return F.coalesce(F.avg(value), F.lit(default))


def median(value: Column, accuracy: int = 10_000) -> Column:
    """Approximate median that returns an element, mergeable across partitions."""
    return F.percentile_approx(value, 0.5, accuracy)


def robust_baseline(df: DataFrame, keys: list[str], value: str, where: Column, hot: Hot = HOT_ROWS) -> DataFrame:
    """Median and median absolute deviation per key over the baseline rows: `baseline`, `mad`."""
    base = df.where(where).select(*keys, value)
    centre = base.groupBy(*keys).agg(median(F.col(value)).alias("baseline"))
    centred = attach(base, centre, keys, hot_keys(base, keys, hot))
    distance = F.abs(F.col(value) - F.col("baseline"))
    return centred.groupBy(*keys).agg(F.first("baseline").alias("baseline"), median(distance).alias("mad"))


def mix_adjusted(df: DataFrame, unit: str, category: str, outcome: str) -> DataFrame:
    """Actual rate per unit beside the rate its own mix would give at overall category rates.

    Rows with a NULL outcome are undecided and left out. Rows collapse to (unit, category) counts
    first; category rates then come from those counts, so no row meets a join.
    Columns: unit, decided, actual, expected.
    """
    cells = (
        df.where(F.col(outcome).isNotNull())
        .groupBy(unit, category)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(outcome)).alias("good"))
    )
    rates = cells.groupBy(category).agg((F.sum("good") / F.sum("n")).alias("rate"))
    return (
        cells.join(rates, category)
        .groupBy(unit)
        .agg(
            F.sum("n").alias("decided"),
            (F.sum("good") / F.sum("n")).alias("actual"),
            (F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("expected"),
        )
    )


def two_level_mean(df: DataFrame, inner: list[str], outer: list[str], alias: str) -> DataFrame:
    """Rows per inner key, averaged by the outer key (the outer columns must be among the inner)."""
    return df.groupBy(*inner).agg(F.count(F.lit(1)).alias("__n")).groupBy(*outer).agg(F.avg("__n").alias(alias))


def histogram(df: DataFrame, band: Column, alias: str = "band", count: str = "n") -> DataFrame:
    """Row counts per band."""
    return df.groupBy(band.alias(alias)).agg(F.count(F.lit(1)).alias(count))


def flows(df: DataFrame, day: Column, kind: str, amount: str, inward: list[str], outward: list[str]) -> DataFrame:
    """Money in and out per day by two sets of kinds."""
    return df.groupBy(day.alias("day")).agg(
        F.sum(F.when(F.col(kind).isin(inward), F.col(amount)).otherwise(0)).alias("money_in"),
        F.sum(F.when(F.col(kind).isin(outward), F.col(amount)).otherwise(0)).alias("money_out"),
    )


def row_json(alias: str = "row_json", *columns: str) -> Column:
    """The row, or the named columns, as one JSON text."""
    return F.to_json(F.struct(*(columns or ["*"]))).alias(alias)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name, duplicates kept."""
    return reduce(DataFrame.unionByName, frames)


def event_series(df: DataFrame, events: dict[str, Column], bucket: str) -> DataFrame:
    """Several time columns of a row as counts per `bucket` in one series; NULL times are skipped.

    One pass: each row lists its events instead of being read once per event.
    """
    listed = F.array(*[F.struct(F.lit(n).alias("event"), F.date_trunc(bucket, t).alias(bucket)) for n, t in events.items()])
    rows = df.select(F.explode(listed).alias("e")).select("e.*").where(F.col(bucket).isNotNull())
    return rows.groupBy(bucket).agg(*[F.count_if(F.col("event") == n).alias(n) for n in events])
