"""Ordered running values per key that stay parallel inside one hot key.

A plain window puts a whole key into one task. Here a hot key is cut into chunks along the order; each chunk is
scanned on its own, and the state at the end of the chunks before it (one row per chunk) is joined
back and added. When no key is hot this is one shuffle and one plain window.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hotkeys import CHUNK, HOT_ROWS, Hot, hot_keys, same_keys, with_chunks


class Scan(NamedTuple):
    kind: str
    value: Column
    strict: bool


def total(value: Column, strict: bool = False) -> Scan:
    """Running sum up to this row; with `strict`, up to the row before it."""
    return Scan("total", value, strict)


def last(value: Column, strict: bool = False) -> Scan:
    """Most recent non-null value up to this row; with `strict`, up to the row before it."""
    return Scan("last", value, strict)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *stages: dict[str, Scan],
    descending: bool = False,
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Add running columns. A later stage may refer to columns made by an earlier one.

    Hot keys are cut along `order`, columns of any orderable type. `order` as a whole should be
    unique per key, otherwise the order among equal rows is unspecified.
    """
    split = hot_keys(df, keys, hot)
    out = with_chunks(df, keys, order, split) if split else df
    for stage in stages:
        out = _stage(out, keys, order, stage, descending, split=bool(split))
    added = [name for stage in stages for name in stage]
    return out.select(*df.columns, *added) if split else out


def _stage(
    df: DataFrame, keys: list[str], order: list[str], scans: dict[str, Scan], descending: bool, split: bool
) -> DataFrame:
    def directed(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    fold = {"total": lambda c: F.sum(c), "last": lambda c: F.last(c, ignorenulls=True)}
    parts = [*keys, CHUNK] if split else keys
    ordered = Window.partitionBy(*parts).orderBy(*[directed(c) for c in order])
    frames = {
        False: ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        True: ordered.rowsBetween(Window.unboundedPreceding, -1),
    }
    local = df.withColumns({n: fold[s.kind](s.value).over(frames[s.strict]) for n, s in scans.items()})
    if not split:
        zeros = {n: F.coalesce(F.col(n), F.lit(0)) for n, s in scans.items() if s.kind == "total"}
        return local.withColumns(zeros) if zeros else local

    # State at the end of each chunk of a hot key, then of all chunks before it.
    at = F.struct(*[F.col(c) for c in order])
    newest = F.min_by if descending else F.max_by
    ends = {"total": lambda c: F.sum(c), "last": lambda c: newest(c, F.when(c.isNotNull(), at))}
    chunk_ends = (
        df.where(F.col(CHUNK).isNotNull())
        .groupBy(*parts)
        .agg(*[ends[s.kind](s.value).alias(f"__end_{n}") for n, s in scans.items()])
    )
    before = Window.partitionBy(*keys).orderBy(directed(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = chunk_ends.select(
        *parts, *[fold[s.kind](F.col(f"__end_{n}")).over(before).alias(f"__carry_{n}") for n, s in scans.items()]
    )
    merged = {}
    for n, s in scans.items():
        own, earlier = F.col(n), F.col(f"__carry_{n}")
        if s.kind == "total":
            merged[n] = F.coalesce(own, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        else:
            merged[n] = F.coalesce(own, earlier)
    return same_keys(local, carry, parts, "left").withColumns(merged).drop(*[f"__carry_{n}" for n in scans])
