"""Streams in event-time order: late rows, timeouts, restarts, open state."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators.windows import islands, run_lengths
from tidemark.session import scratch_path
from tidemark.streaming import ordered
from tidemark.streaming.incremental import VERSION, write_batches

START = datetime(2024, 1, 1)
ROWS = "key string, id long, ts timestamp_ntz, on boolean, value double"
KINDS = {"low": "min", "high": "max", "sum": "sum"}


def measures():
    return {name: (kind, F.col("value")) for name, kind in KINDS.items()}


@pytest.fixture(autouse=True)
def store(spark):
    ordered.rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def made(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = START + timedelta(minutes=i * 7 + rng.randint(0, 6))
        out.append((rng.choice("abc"), i, at, rng.choice([True, True, True, False, None]), rng.choice([None, round(rng.random(), 3)])))
    return out


def batches(rows, parts, late):
    """Rows by arrival, each up to `late` minutes after its time, and a heartbeat at the end."""
    rng = random.Random(8)
    arriving = sorted(rows, key=lambda r: (r[2] + timedelta(minutes=rng.uniform(0, late)), r[1]))
    size = -(-len(arriving) // parts)
    return [arriving[i : i + size] for i in range(0, len(arriving), size)] + [[(None, None, START + timedelta(days=900), None, None)]]


def run(spark, parts, query):
    source, path, checkpoint = (scratch_path(spark, x) for x in ("source", "sink", "checkpoint"))
    seen = []
    for part in parts:
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROWS).parquet(source)
        write_batches(query(stream), path, checkpoint, mode="append").awaitTermination()
        seen.append(spark.read.parquet(path).drop(VERSION).count())
    return spark.read.parquet(path).drop(VERSION), checkpoint, seen


def plain(df, columns):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("gap", [None, "30 minutes"])
def test_islands_of_shuffled_arrivals(spark, gap):
    rows = made()
    aggs = [F.min("ts").alias("started_at"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("sum")]
    expected = islands(spark.createDataFrame(rows, ROWS), ["key"], ["ts", "id"], F.col("on"), aggs, 2, gap)
    found, checkpoint, seen = run(
        spark, batches(rows, 3, 120), lambda s: ordered.islands_stream(s, ["key"], "ts", F.col("on"), measures(), "3 hours", ["id"], 2, gap)
    )
    left = ordered.open_islands(spark, checkpoint, list(KINDS), 2)
    columns = ["key", "started_at", "last_ts", "rows", *KINDS]
    assert plain(found.unionByName(left), columns) == plain(expected, columns)
    assert 0 < seen[0] < seen[-1]  # islands come out while the stream runs
    assert left.count() == 0 if gap else left.count() <= 3  # at most one open island per key is left
    waiting = spark.read.format("statestore").option("stateVarName", ordered.WAITING).load(checkpoint)
    assert waiting.count() == 0


def test_rows_behind_the_watermark_change_nothing(spark):
    rows = [("a", i, START + timedelta(minutes=10 * i), True, 1.0) for i in range(20)]
    late = [("a", 99, START + timedelta(minutes=35), False, 1.0)]
    parts = [rows, late, [(None, None, START + timedelta(days=900), None, None)]]
    found, _, _ = run(spark, parts, lambda s: ordered.islands_stream(s, ["key"], "ts", F.col("on"), {}, "1 minute", max_gap="1 hour"))
    assert [(r.rows, r.started_at) for r in found.collect()] == [(20, START)]


def test_run_lengths_of_shuffled_arrivals(spark):
    rows = made(300, 5)
    flags = {"n_on": F.col("on"), "n_low": F.col("value") < 0.5}
    expected = run_lengths(spark.createDataFrame(rows, ROWS), ["key"], ["ts"], flags)
    found, checkpoint, _ = run(spark, batches(rows, 3, 60), lambda s: ordered.run_lengths_stream(s, ["key"], "ts", flags, ["id", "value"], "2 hours"))
    columns = ["key", "id", "ts", "value", *flags]
    assert plain(found, columns) == plain(expected, columns)


def test_keys_share_the_state_of_their_group(spark):
    """A group of keys stores its rows in pages and has one timer, whatever the number of its keys: each costs a call."""
    schema = ROWS.replace("id long", "id long, many long")
    rows = [(f"k{i % 300}", i, None if i % 2 else i, START + timedelta(minutes=i), i % 4 > 0, 1.0) for i in range(1_200)]
    aggs = [F.min("ts").alias("started_at"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("rows"), F.sum("many").alias("sum")]
    expected = islands(spark.createDataFrame(rows, schema), ["key"], ["ts"], F.col("on"), aggs)
    source, path, checkpoint = (scratch_path(spark, x) for x in ("source", "sink", "checkpoint"))
    for part in (rows, [(None, None, None, START + timedelta(days=900), None, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = ordered.islands_stream(
            spark.readStream.schema(schema).parquet(source), ["key"], "ts", F.col("on"), {"sum": ("sum", F.col("many"))}, "10 hours", groups=8
        )
        write_batches(stream, path, checkpoint, mode="append").awaitTermination()
        if part is rows:
            stored = {name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count() for name in (ordered.WAITING, ordered.DUE)}
            assert all(0 < n <= 8 for n in stored.values())
    columns = ["key", "started_at", "last_ts", "rows", "sum"]
    found = spark.read.parquet(path).drop(VERSION).unionByName(ordered.open_islands(spark, checkpoint, ["sum"]))
    assert plain(found, columns) == plain(expected, columns)


def test_records_of_a_group_lie_in_pages(spark):
    """What the keys of a group remember is stored together: a call per key would cost more than its rows."""
    schema = ROWS + ", born timestamp, day date, price decimal(27,6)"
    rows = [
        (f"k{i % 300}", i, START + timedelta(minutes=i), i % 7 > 0, 1.0, START + timedelta(days=i % 300, microseconds=5), START.date(), Decimal(i) / 8 if i % 3 else None)
        for i in range(1_200)
    ]
    keys = ["key", "born", "day"]
    aggs = [F.min("ts").alias("started_at"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("rows"), F.min("price").alias("least"), F.max("price").alias("most")]
    expected = islands(spark.createDataFrame(rows, schema), keys, ["ts"], F.col("on"), aggs)
    source, path, checkpoint = (scratch_path(spark, x) for x in ("source", "sink", "checkpoint"))
    wanted = {"least": ("min", F.col("price")), "most": ("max", F.col("price"))}
    for part in (rows[:700], rows[700:], [(None, None, START + timedelta(days=900), None, None, None, None, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = ordered.islands_stream(spark.readStream.schema(schema).parquet(source), keys, "ts", F.col("on"), wanted, "1 hour", groups=8)
        write_batches(stream, path, checkpoint, mode="append").awaitTermination()
    left = ordered.open_islands(spark, checkpoint, [*wanted])
    assert 200 < left.count() <= 300
    assert spark.read.format("statestore").option("stateVarName", ordered.MEMORY).load(checkpoint).count() <= 8
    columns = [*keys, "started_at", "last_ts", "rows", *wanted]
    assert plain(spark.read.parquet(path).drop(VERSION).unionByName(left), columns) == plain(expected, columns)


def test_a_late_row_among_others_changes_nothing(spark):
    rows = [("a", i, START + timedelta(minutes=10 * i), True, 1.0) for i in range(20)]
    mixed = [("a", 99, START + timedelta(minutes=35), False, 1.0), ("a", 20, START + timedelta(minutes=200), True, 1.0)]
    parts = [rows, mixed, [(None, None, START + timedelta(days=900), None, None)]]
    found, _, _ = run(spark, parts, lambda s: ordered.islands_stream(s, ["key"], "ts", F.col("on"), {}, "1 minute", max_gap="1 hour"))
    assert [(r.rows, r.started_at) for r in found.collect()] == [(21, START)]
