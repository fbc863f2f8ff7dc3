"""Window operators: latest row, gaps, islands, runs, trailing spans, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hotkeys import CHUNK, HOT_ROWS, Hot, hot_keys, same_keys, with_chunks
from .scan import last, running, total


def latest_row(df: DataFrame, keys: list[str], order: list[str], newest: bool = True) -> DataFrame:
    """One row per key, the greatest by `order` (the smallest with newest=False).

    An aggregate, not a window: each task sorts its rows by key and passes on one per key, so a hot key adds
    no more than a row per task to the shuffle.
    """
    pick = F.max_by if newest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def top1_per_group(df: DataFrame, keys: list[str], value: str, measure: str, alias: str) -> DataFrame:
    """The `value` with the largest `measure` per group; ties go to the smallest value."""
    return df.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col(measure), F.col(value))).alias(alias))


def previous(
    df: DataFrame, keys: list[str], order: list[str], column: str, alias: str, hot: Hot = HOT_ROWS
) -> DataFrame:
    """`lag(column)`: the value on the row before, NULL on the first row of a key."""
    boxed = running(df, keys, order, {"__prev": last(F.struct(F.col(column)), strict=True)}, hot=hot)
    return boxed.withColumn(alias, F.col(f"__prev.{column}")).drop("__prev")


def with_islands(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    flag: Column,
    alias: str = "island",
    max_gap: str | None = None,
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Number the runs of consecutive flagged rows: `alias` is the count of breaks up to the row.

    Rows count, not time: a missing interval does not end a run. With `max_gap` (an interval such as
    '2 hours') a larger distance to the row before also starts a new run.
    """
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    breaks = F.when(F.col("__flag"), 0).otherwise(1)
    stages = [{alias: total(breaks)}]
    if max_gap:
        late = F.col(order[0]) > F.col("__before") + F.expr(f"INTERVAL {max_gap}")
        breaks = breaks + F.when(F.col("__flag") & late, 1).otherwise(0)
        stages = [{"__before": last(F.col(order[0]), strict=True)}, {alias: total(breaks)}]
    return running(marked, keys, order, *stages, hot=hot).drop("__flag", "__before")


def islands(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    flag: Column,
    aggs: list[Column],
    min_rows: int = 1,
    max_gap: str | None = None,
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """One row per run of at least `min_rows` consecutive flagged rows, with `aggs` over the run."""
    numbered = with_islands(df, keys, order, flag, "__island", max_gap, hot)
    runs = numbered.where(flag).groupBy(*keys, "__island").agg(*aggs, F.count(F.lit(1)).alias("__n"))
    return runs.where(F.col("__n") >= min_rows).drop("__island", "__n")


def run_lengths(
    df: DataFrame, keys: list[str], order: list[str], flags: dict[str, Column], hot: Hot = HOT_ROWS
) -> DataFrame:
    """Per name, how many rows in a row up to this one have the flag (0 on an unflagged row).

    "All of the last n rows" is `length >= n`, without a per-row frame.
    """
    on = {n: F.coalesce(f, F.lit(False)) for n, f in flags.items()}
    counted = {f"__sum_{n}": total(F.when(f, 1).otherwise(0)) for n, f in on.items()}
    based = {f"__base_{n}": last(F.when(~f, F.col(f"__sum_{n}"))) for n, f in on.items()}
    out = running(df, keys, order, counted, based, hot=hot)
    lengths = {n: F.col(f"__sum_{n}") - F.coalesce(F.col(f"__base_{n}"), F.lit(0)) for n in flags}
    return out.withColumns(lengths).drop(*counted, *based)


def rolling_rows(
    df: DataFrame, keys: list[str], order: list[str], preceding: int, aggs: dict[str, Column], hot: Hot = HOT_ROWS
) -> DataFrame:
    """`ROWS BETWEEN preceding PRECEDING AND CURRENT ROW` aggregates.

    A hot key is cut along `order`; every chunk but the first also gets the last `preceding` rows before it, as
    context that is dropped again.
    """
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-preceding, Window.currentRow)
    split = hot_keys(df, keys, hot)
    if not split:
        return df.withColumns({n: a.over(frame) for n, a in aggs.items()})
    chunked = with_chunks(df, keys, order, split).withColumn("__context", F.lit(False))
    parts = [*keys, CHUNK]
    ahead = chunked.where(F.col(CHUNK).isNotNull())
    backwards = Window.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in order])
    tails = ahead.withColumn("__back", F.row_number().over(backwards)).where(F.col("__back") <= preceding)
    # a short chunk passes on what it was given: rows travel to as many later chunks as still see them
    sizes = ahead.groupBy(*parts).agg(F.count(F.lit(1)).alias("__size"))
    later = sizes.withColumnsRenamed({CHUNK: "__to"}).withColumn(
        "__between", F.coalesce(F.sum("__size").over(Window.partitionBy(*keys).orderBy("__to").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    own = later.select(*keys, F.col("__to").alias(CHUNK), (F.col("__between") + F.col("__size")).alias("__upto"))
    reach = same_keys(tails, own, parts)
    moved = same_keys(reach, later.select(*keys, "__to", "__between"), keys).where(
        (F.col("__to") > F.col(CHUNK)) & (F.col("__between") - F.col("__upto") + F.col("__back") <= preceding)
    )
    context = moved.withColumn(CHUNK, F.col("__to")).withColumn("__context", F.lit(True)).select(*chunked.columns)
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(-preceding, Window.currentRow)
    done = chunked.unionByName(context).withColumns({n: a.over(inside) for n, a in aggs.items()})
    return done.where(~F.col("__context")).select(*df.columns, *aggs)


def trailing_span(
    df: DataFrame,
    keys: list[str],
    ts: str,
    span: str,
    measures: dict[str, Column],
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Sums over the trailing time span, both ends included, one row per key and distinct instant.

    Same values as `RANGE BETWEEN INTERVAL span PRECEDING AND CURRENT ROW`. Each instant enters at
    its own time and leaves just after `ts + span`; the running sum of entries minus departures is
    the window total, so no row is compared with another. Measures should be integers.
    """
    names = list(measures)
    points = df.groupBy(*keys, ts).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    moves = F.array(
        F.struct(F.col(ts).alias("t"), F.lit(0).alias("leaving"), *names),
        F.struct(
            (F.col(ts) + F.expr(f"INTERVAL {span}")).alias("t"),
            F.lit(1).alias("leaving"),
            *[(-F.col(n)).alias(n) for n in names],
        ),
    )
    events = points.select(*keys, F.explode(moves).alias("e")).select(
        *keys, F.col("e.t").alias(ts), F.col("e.leaving").alias("__leaving"), *[F.col(f"e.{n}") for n in names]
    )
    sums = {f"__t_{n}": total(F.col(n)) for n in names}
    swept = running(events, keys, [ts, "__leaving"], sums, hot=hot)
    return swept.where(F.col("__leaving") == 0).select(*keys, ts, *[F.col(f"__t_{n}").alias(n) for n in names])


def paged_lists(
    df: DataFrame, keys: list[str], value: str, alias: str, page_size: int = 10_000, hot: Hot = HOT_ROWS
) -> DataFrame:
    """Distinct values per key in ascending order, as arrays of at most `page_size` values.

    Pages count from 0 and follow the order: concatenating a key's pages gives its whole sorted list. NULL values are
    left out; a key with NULL values only has one empty page.
    """
    distinct = df.select(*keys, value).distinct()
    ranked = running(distinct, keys, [value], {"__pos": total(F.when(F.col(value).isNotNull(), 1).otherwise(0))}, hot=hot)
    page = F.floor((F.greatest(F.col("__pos"), F.lit(1)) - 1) / page_size).cast("long")
    return ranked.groupBy(*keys, page.alias("page")).agg(F.sort_array(F.collect_list(value)).alias(alias))


def threads(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    line: Column,
    alias: str = "thread",
    separator: str = "\n",
    page_rows: int = 10_000,
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Rows of a key joined into one text in `order`, split into pages of `page_rows` rows.

    Page numbers count from 0; concatenating a key's pages in order gives the whole thread, and a
    key with up to `page_rows` rows has exactly one page.
    """
    numbered = df.withColumns({"__line": line, "__at": F.struct(*order)})
    ranked = running(numbered, keys, order, {"__pos": total(F.lit(1))}, hot=hot)
    pages = ranked.withColumn("page", F.floor((F.col("__pos") - 1) / page_rows).cast("long"))
    lines = F.sort_array(F.collect_list(F.struct(F.col("__pos").alias("p"), F.col("__line").alias("t"))))
    joined = F.array_join(F.transform(lines, lambda x: x["t"]), separator)
    return pages.groupBy(*keys, "page").agg(
        joined.alias(alias), F.count(F.lit(1)).alias("n_lines")
    )
