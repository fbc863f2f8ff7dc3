"""Finding the few keys that hold an outsized share of the rows, and splitting them.

A key counts as hot when it has at least `threshold` rows AND more than 1/MAX_HOT_KEYS of all rows.
By the second test fewer than MAX_HOT_KEYS keys can qualify whatever the data, so the list fits the
driver and a broadcast at any scale. Every other key holds at most 1/MAX_HOT_KEYS of the rows.
Finding the list is one pass over the key columns with map-side counts. NULL keys are keys like any other.

Operators take `hot`: a row threshold (they look for hot keys themselves), a `HotKeys` already found
(to share one pass between operators on the same key), or None (groups are bounded by construction).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import staged

MAX_HOT_KEYS = 100_000
HOT_ROWS = 1_000_000
TASK_ROWS = 250_000
CHUNK = "__chunk"
#: Fixed value: where `monotonically_increasing_id` has the number of the partition.
PART_BITS = 33


@dataclass(frozen=True)
class HotKeys:
    """Hot keys, the number of rows a chunk of one should have, and how many rows each key has."""

    keys: list[Row]
    threshold: int
    counts: tuple[int, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.keys)

    def frame(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """The keys as a DataFrame to broadcast: fewer than MAX_HOT_KEYS rows."""
        return F.broadcast(df.sparkSession.createDataFrame(self.keys, df.select(*keys).schema))


Hot = HotKeys | int | None


def hot_keys(df: DataFrame, keys: list[str], hot: Hot = HOT_ROWS) -> HotKeys:
    """The hot keys of `df`; counts and their total come from one pass."""
    if hot is None:
        return HotKeys([], HOT_ROWS)
    if isinstance(hot, HotKeys):
        return hot
    both = df.select(*keys).groupingSets([[F.col(k) for k in keys], []], *keys)
    counts = both.agg(F.count(F.lit(1)).alias("__rows"), F.grouping_id().alias("__all"))
    largest = counts.where(F.col("__rows") >= hot).orderBy(F.desc("__all"), F.desc("__rows")).limit(MAX_HOT_KEYS + 1).collect()
    total = largest[0]["__rows"] if largest else 0
    found = [r for r in largest[1:] if r["__rows"] * MAX_HOT_KEYS > total]
    return HotKeys([Row(**{k: r[k] for k in keys}) for r in found], hot, tuple(r["__rows"] for r in found))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the keys appear once."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def by_count(df: DataFrame, rows: int) -> DataFrame:
    """`df`, which has so many rows, as one side of a join: broadcast if they are fewer than MAX_HOT_KEYS, else shuffled.

    Spark goes by the size of files, and packed files of sorted keys look small however many rows they have.
    """
    return F.broadcast(df) if rows < MAX_HOT_KEYS else df.hint("merge")


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], hot: HotKeys) -> DataFrame:
    """Join one row per key onto `df` without moving the rows of hot keys.

    The hot keys' part of `per_key` has fewer than MAX_HOT_KEYS rows and is broadcast; other rows
    meet theirs in an ordinary join. NULL keys meet nothing, as in any join.
    """
    if not hot:
        return df.join(per_key, keys)
    few = hot.frame(df, keys)
    usual = df.join(few, keys, "left_anti").join(per_key, keys)
    split = df.join(F.broadcast(per_key.join(few, keys, "left_semi")), keys)
    return usual.unionByName(split)


def with_parts(df: DataFrame, keys: list[str], part: Column, hot: HotKeys, name: str = CHUNK) -> DataFrame:
    """Add `name`: the part number for rows of hot keys, NULL for all others."""
    few = hot.frame(df, keys).withColumn("__hot", F.lit(True))
    return same_keys(df, few, keys, "left").withColumn(name, F.when(F.col("__hot"), part)).drop("__hot")


def with_chunks(df: DataFrame, keys: list[str], order: list[str], hot: HotKeys) -> DataFrame:
    """Add CHUNK: for rows of hot keys a number that ascends along `order`, at most `threshold` rows each; NULL for others.

    The hot keys' rows are dealt by range of key and order, as Spark sorts whole tables, and each part is cut into chunks by
    rank; no bound leaves that shuffle. Ranges follow the rows and not the values, whatever their type, and ties on the
    first order column are split by the others. The rows are written once, so that every plan sees the same chunks.
    """
    few = hot.frame(df, keys)
    along = [*keys, *(c for c in order if c not in keys)]
    crowd = same_keys(df, few, keys, "left_semi").repartitionByRange(*along).sortWithinPartitions(*along)
    # the number has the part in its upper bits and the rank within the part in the lower 33
    number = F.monotonically_increasing_id()
    part, rank = F.shiftright(number, PART_BITS), number.bitwiseAND(F.lit((1 << PART_BITS) - 1))
    chunk = F.shiftleft(part, PART_BITS) + F.floor(rank / hot.threshold).cast("long")
    dealt = staged(crowd.withColumn(CHUNK, chunk), "chunks")
    return same_keys(df, few, keys, "left_anti").withColumn(CHUNK, F.lit(None).cast("long")).unionByName(dealt)


def dealt(df: DataFrame, keys: list[str], rows: int, per_task: int = TASK_ROWS) -> DataFrame:
    """`df`, of about `rows` rows, by hash of the keys in parts of about `per_task` rows, whatever the number that shuffles
    have: what a task sorts or aggregates does not grow with the table. For keys none of which is hot."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task))
    return df.repartition(parts, *keys)


def join_dimension(df: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table that is usually small. Spark broadcasts it if its size, as estimated or as found while running, is
    below `spark.sql.autoBroadcastJoinThreshold`; otherwise adaptive execution splits skewed partitions."""
    return df.join(dim, on, how)
