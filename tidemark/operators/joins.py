"""Join shapes: spine joins, as-of marks, interval totals, bucketed interval joins, key checks.

No broadcast hints: Spark broadcasts a side only below its own size threshold, and adaptive
execution splits skewed partitions of the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hotkeys import HOT_ROWS, Hot
from .scan import last, running, total


def spine_join(spine: DataFrame, parts: list[DataFrame], on: list[str], fill: dict | None = None) -> DataFrame:
    """Left join pre-aggregated parts onto the spine; `fill` replaces NULL per column."""
    out = reduce(lambda left, part: left.join(part, on, "left"), parts, spine)
    return out.fillna(fill) if fill else out


def complete_dimension(dim: DataFrame, agg: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """Every member of the dimension appears; measures without rows take the fill value."""
    return spine_join(dim, [agg], on, fill)


def pick_child(
    parents: DataFrame, children: DataFrame, on: list[str], order: list[str], columns: list[str], newest: bool = True
) -> DataFrame:
    """Each parent with its newest (or oldest) child row by `order`; parents without one are kept."""
    pick = F.max_by if newest else F.min_by
    best = children.groupBy(*on).agg(pick(F.struct(*columns), F.struct(*order)).alias("__child"))
    kept = [c for c in parents.columns]
    return parents.join(best, on, "left").select(*kept, *[F.col(f"__child.{c}").alias(c) for c in columns])


def flag_exists(df: DataFrame, matches: DataFrame, on: list[str], alias: str) -> DataFrame:
    """Add a boolean: does any row of `matches` share the key? Rows are neither lost nor repeated."""
    hit = matches.select(*on).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, on, "left").withColumn(alias, F.coalesce("__hit", F.lit(False))).drop("__hit")


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Child rows whose key is missing from the parent (a failed reference check)."""
    return child.join(parent.select(*on).distinct(), on, "left_anti")


def reference_report(checks: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """One row per named check with its number of orphans."""
    rows = [
        orphans(c, p, on).agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(n).alias("reference"), "orphans")
        for n, (c, p, on) in checks.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def nearest_mark(
    rows: DataFrame,
    marks: DataFrame,
    keys: list[str],
    ts: str,
    alias: str,
    forward: bool,
    strict: bool = False,
    payload: list[str] | None = None,
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Per row, the time of the closest mark of the same key at or before it (`forward`: at or after).

    `strict` excludes a mark at the row's own instant. With `payload`, a struct of the mark's `ts` and
    those columns instead of the bare time. Rows and marks are scanned together in time order, so no
    row-mark pairs are formed.
    """
    packed = [c for c in rows.columns if c not in keys and c != ts]
    mark_value = F.struct(F.col(ts), *payload) if payload else F.col(ts)
    # Among equal instants a mark comes first in scan order, or last when it must not count.
    mark_rank = (0 if forward else 1) if strict else (1 if forward else 0)
    left = rows.select(
        *keys, ts, F.lit(1 - mark_rank).alias("__rank"), F.struct(F.lit(True).alias("__is_row"), *packed).alias("__row")
    )
    right = marks.select(*keys, ts, F.lit(mark_rank).alias("__rank"), mark_value.alias(alias))
    both = left.unionByName(right, allowMissingColumns=True)
    seen = running(
        both.withColumnRenamed(alias, "__mark"),
        keys,
        [ts, "__rank"],
        {alias: last(F.col("__mark"))},
        descending=forward,
        hot=hot,
    )
    return seen.where(F.col("__row.__is_row")).select(*keys, ts, *[F.col(f"__row.{c}") for c in packed], alias)


def interval_totals(
    probes: DataFrame,
    facts: DataFrame,
    keys: list[str],
    ts: str,
    probe_id: list[str],
    lo: Column,
    hi: Column,
    measures: dict[str, Column],
    include_lo: bool = False,
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Per probe, sums of the fact measures with `lo < ts <= hi` (`lo <= ts` with include_lo).

    The running sum at `hi` minus the one at `lo`, from one ordered pass over facts and probe ends,
    so the work grows with rows and not with matching pairs. Use integer measures: sums are then
    exact. Returns keys, probe_id and the measures (0 where nothing falls in).
    """
    names = list(measures)
    ids = F.struct(*probe_id)
    fact_rows = facts.groupBy(*keys, ts).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    fact_rows = fact_rows.withColumns({"__rank": F.lit(1), "__sign": F.lit(0)})
    ends = F.array(
        F.struct(lo.alias("t"), F.lit(0 if include_lo else 2).alias("r"), F.lit(-1).alias("s")),
        F.struct(hi.alias("t"), F.lit(2).alias("r"), F.lit(1).alias("s")),
    )
    probe_rows = probes.select(*keys, ids.alias("__id"), F.explode(ends).alias("e")).select(
        *keys, F.col("e.t").alias(ts), F.col("e.r").alias("__rank"), F.col("e.s").alias("__sign"), "__id"
    )
    both = fact_rows.unionByName(probe_rows, allowMissingColumns=True)
    swept = running(
        both, keys, [ts, "__rank"], {f"__t_{n}": total(F.col(n)) for n in names}, hot=hot
    )
    return (
        swept.where(F.col("__sign") != 0)
        .groupBy(*keys, "__id")
        .agg(*[F.sum(F.col("__sign") * F.col(f"__t_{n}")).alias(n) for n in names])
        .select(*keys, "__id.*", *names)
    )


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    ts: str,
    lo: str,
    hi: str,
    width_seconds: int,
    how: str = "inner",
) -> DataFrame:
    """Points joined to the intervals of the same key that contain them (`lo <= ts <= hi`).

    Time is cut into buckets of `width_seconds`; an interval is listed once in each bucket it
    touches and a point sits in one, so the equi join runs on (key, bucket) and one key spreads over
    many partitions. Choose the width near the usual interval length. `how` may be inner, left_semi
    or left_anti (seen from the points).
    """
    def bucket(c: Column) -> Column:
        return F.floor(F.unix_micros(c.cast("timestamp")) / (width_seconds * 1_000_000))

    spans = intervals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi)))).alias("__span_bucket"),
        *[c for c in intervals.columns if c not in keys],
    )
    left = points.withColumn("__bucket", bucket(F.col(ts)))
    on = (F.col("__bucket") == F.col("__span_bucket")) & F.col(ts).between(F.col(lo), F.col(hi))
    on = reduce(lambda acc, k: acc & (F.col(k) == F.col(f"__k_{k}")), keys, on)
    return left.join(spans, on, how).drop("__bucket", "__span_bucket", *[f"__k_{k}" for k in keys])


def hex_key(binary: Column) -> Column:
    """Binary identifier as lower-case hex text."""
    return F.lower(F.hex(binary))


def uuid_key(text: Column) -> Column:
    """UUID text without dashes, lower case: the same form as `hex_key`."""
    return F.lower(F.replace(text, F.lit("-"), F.lit("")))
