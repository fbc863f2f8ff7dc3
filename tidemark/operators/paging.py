"""Ordered pages and top-n reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by an order that ends in a unique column: per-task top n, then one merge."""
    return df.orderBy(*order).limit(int(n))


def keyset_page(
    df: DataFrame, ts: str, key: str, n: int, after: tuple | None = None, before: tuple | None = None
) -> DataFrame:
    """Newest-first page of n rows with a `has_more` column, relative to a (ts, key) cursor.

    `after` keeps rows newer than the cursor and `before` older ones; both list the newest first,
    so `after` gives the newest page and not the adjacent one. One row past the page is fetched to
    learn whether more exist.
    """
    at, rows = F.struct(F.col(ts), F.col(key)), df
    if after is not None:
        cursor = _cursor(df, ts, key, after)
        rows = rows.where((F.col(ts) >= cursor[0]) & (at > F.struct(*cursor)))
    elif before is not None:
        cursor = _cursor(df, ts, key, before)
        rows = rows.where((F.col(ts) <= cursor[0]) & (at < F.struct(*cursor)))
    newest = [F.col(ts).desc(), F.col(key).desc()]
    # n + 1 rows, counted where they are
    ahead = rows.orderBy(*newest).limit(n + 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    return ahead.withColumn("has_more", F.col("__n") > n).orderBy(*newest).limit(n).drop("__n")


def _cursor(df: DataFrame, ts: str, key: str, cursor: tuple) -> tuple[Column, Column]:
    """The cursor's values in the columns' types; the one on `ts` is a conjunct of its own, which scans can use."""
    types = dict(df.dtypes)
    return F.lit(cursor[0]).cast(types[ts]).alias(ts), F.lit(cursor[1]).cast(types[key]).alias(key)
