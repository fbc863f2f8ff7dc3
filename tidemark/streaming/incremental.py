"""Change histories as streams.

State lives in Spark's state store; set `spark.sql.streaming.stateStore.providerClass` to the
RocksDB provider when keys outgrow memory. Sinks write one folder per batch id, so a batch that is
replayed after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.cdc import ChangeSpec, daily_totals, drop_deleted, latest_changes
from ..sources import tables
from ..sources.files import path_exists

VERSION = "batch_id"


def write_batches(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "update") -> StreamingQuery:
    """Start a query that writes the changed rows of each batch to `path`/batch_id=n."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{VERSION}={batch_id}")

    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_versions(spark: SparkSession, path: str, keys: list[str], schema: StructType | None = None) -> DataFrame:
    """The newest stored row per key. With `schema`, the rows' columns, there may be no batch yet."""
    reader = spark.read
    if schema is not None:
        if not path_exists(spark, f"{path}/{VERSION}=*"):
            return spark.createDataFrame([], schema)
        reader = reader.schema(StructType([*schema.fields, StructField(VERSION, LongType())]))
    rows = reader.parquet(path)
    best = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        F.max_by(F.struct("*"), F.col(VERSION)).alias("__row")
    )
    return best.select("__row.*").drop(VERSION)


def compact_versions(spark: SparkSession, path: str, keys: list[str], partitions: list[str] | None = None) -> int:
    """Fold all stored batches but the newest into the one before it; returns how many folders are left.

    `partitions` are folder columns inside each batch, such as a bucket, that the folded batch keeps.

    The newest batch stays by itself: it is the only one a restarted query may write again. Between batches or beside
    a running query, readers see the same rows before, while and after: the folded folder takes the place of the last
    one it holds by a switch, and the folders before it, whose rows it has, go afterwards.
    """
    found = spark.read.parquet(path).select(VERSION).distinct().orderBy(VERSION).collect()
    batches = [r[0] for r in found]
    if len(batches) < 3:
        return len(batches)
    last = batches[-2]
    folded = spark.read.parquet(path).where(F.col(VERSION) <= last)
    best = folded.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct("*"), F.col(VERSION)).alias("__row"))
    made = f"{path}/_folded.{uuid4().hex}"
    best.select("__row.*").drop(VERSION).write.partitionBy(*(partitions or [])).parquet(made)
    tables.switch(spark, made, f"{path}/{VERSION}={last}")
    for batch in batches[:-2]:
        tables.remove(spark, f"{path}/{VERSION}={batch}")
    return 2


def scd1_stream(changes: DataFrame, spec: ChangeSpec, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Maintain current state from a streaming change history.

    The state keeps the highest-sequence change per key, deletes included, so late lower sequences
    change nothing. Read the result with `scd1_current`.
    """
    return write_batches(latest_changes(changes, spec), path, checkpoint, trigger)


def scd1_current(spark: SparkSession, path: str, spec: ChangeSpec) -> DataFrame:
    """Current rows kept by `scd1_stream`."""
    return drop_deleted(latest_versions(spark, path, spec.keys), spec)


def daily_totals_stream(
    changes: DataFrame,
    keys: list[str],
    ts: str,
    day: str,
    measures: dict[str, Column],
    spec: ChangeSpec,
    path: str,
    checkpoint: str,
    watermark: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Daily sums over change rows that are not deletes, updated as rows arrive.

    Without a watermark every late row counts and state grows with keys and days. With one, the day
    becomes a one-day event-time window; state is bounded, and rows later than that are not added.
    """
    if watermark is None:
        totals = daily_totals(changes, keys, ts, day, measures, spec)
    else:
        live = changes.where(~spec.deleted()).withWatermark(ts, watermark)
        windows = live.groupBy(*keys, F.window(ts, "1 day")).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
        totals = windows.select(*keys, F.to_date("window.start").alias(day), *measures)
    return write_batches(totals, path, checkpoint, trigger)


def publish_continuous(
    changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Hand each batch of changed rows to `apply`, such as an upsert into a serving table.

    `apply` may see a batch again after a failure, so it has to be idempotent; keyed upserts are.
    """
    return (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: apply(batch))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
