"""Change histories, table maintenance and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import cdc, maintenance
from ..plans import factory, network, support_live
from ..session import scratch_path, staged
from ..sources import files, tables
from ..streaming import incremental as streams
from ..streaming import ordered
from .domains import DAILY_REVENUE_COLUMNS, INCIDENT_COLUMNS, SQL_DAILY_REVENUE, SQL_INCIDENTS, SQL_SCORED
from .registry import Entry, Tables

CHANGES = cdc.ChangeSpec(keys=["id"])
SQL_STATE = """SELECT id, status, amount FROM {c_changes} QUALIFY row_number() OVER (PARTITION BY id ORDER BY _pg_lsn DESC) = 1
    AND _pg_change_type <> 'delete'"""


def _event_stream(t: Tables):
    """The events file as a streaming source."""
    return files.read_change_log(t.spark, t.folder, t.events.schema, stream=True, files="events.parquet")


def _change_stream(t: Tables):
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return _event_stream(t).select(
        F.col("user_id").alias("id"),
        F.col("event_type").alias("status"),
        F.col("value").alias("amount"),
        kind.alias("_pg_change_type"),
        F.col("event_id").alias("_pg_lsn"),
        F.lit(0).alias("_pg_xid"),
        F.col("ts").alias("_timestamp"),
        F.col("event_id").alias("_sort_by"),
    )


def scd1_stream(t: Tables):
    path, checkpoint = scratch_path(t.spark, "scd1"), scratch_path(t.spark, "scd1-checkpoint")
    streams.scd1_stream(_change_stream(t), CHANGES, path, checkpoint).awaitTermination()
    return streams.scd1_current(t.spark, path, CHANGES)


def daily_stream(t: Tables):
    path, checkpoint = scratch_path(t.spark, "daily"), scratch_path(t.spark, "daily-checkpoint")
    measures = {"events": F.lit(1), "cents": F.round(F.col("amount") * 100).cast("long")}
    streams.daily_totals_stream(
        _change_stream(t), ["id"], "_timestamp", "day", measures, CHANGES, path, checkpoint
    ).awaitTermination()
    return streams.latest_versions(t.spark, path, ["id", "day"])


def daily_windows(t: Tables):
    """The same totals from one-day windows behind a watermark that no row of the table is late for."""
    path, checkpoint = scratch_path(t.spark, "windows"), scratch_path(t.spark, "windows-checkpoint")
    measures = {"events": F.lit(1), "cents": F.round(F.col("amount") * 100).cast("long")}
    changes = _change_stream(t).withColumn("_timestamp", F.col("_timestamp").cast("timestamp"))
    streams.daily_totals_stream(changes, ["id"], "_timestamp", "day", measures, CHANGES, path, checkpoint, watermark="3650 days").awaitTermination()
    return streams.latest_versions(t.spark, path, ["id", "day"])


def refreshed_view(t: Tables):
    """A served table that every batch of the stream refreshes by a keyed upsert."""
    target, checkpoint = scratch_path(t.spark, "view"), scratch_path(t.spark, "view-checkpoint")
    changes = cdc.latest_changes(_change_stream(t), CHANGES)
    t.spark.createDataFrame([], changes.schema).write.parquet(target)
    streams.publish_continuous(changes, lambda batch: tables.upsert_table(t.spark, target, batch, CHANGES.keys), checkpoint).awaitTermination()
    return cdc.drop_deleted(t.spark.read.parquet(target), CHANGES)


def _span(rows) -> tuple[int, int]:
    """First and last microsecond of a `ts` column; one row comes to the driver."""
    ends = rows.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("s")).agg(F.min("s").alias("low"), F.max("s").alias("high")).first()
    return ends.low or 0, ends.high or 0


def _arrivals(t: Tables, rows, source: str, late: int, parts: int = 3):
    """Rows with a `ts`, written to the folder `source` as they might arrive: in parts by time, each row up to `late`
    microseconds after its time. A heartbeat without key, past everything, comes last. Yields after each part.
    """
    low, high = _span(rows)
    arrived = F.unix_micros(F.col("ts").cast("timestamp")) - low + F.pmod(F.xxhash64(*rows.columns), F.lit(late))
    part = F.least(F.lit(parts - 1), F.floor(arrived * parts / (high - low + late + 1)))
    arranged = staged(rows.withColumn("part", part), "arrivals")
    for i in range(parts):
        arranged.where(F.col("part") == i).drop("part").write.mode("append").parquet(source)
        yield
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"))
    end.select(*(F.col("ts") if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns)).write.mode("append").parquet(source)
    yield


def _streamed(t: Tables, rows, query, name: str):
    """Run a streaming query over late arrivals, stopped and resumed after each part; its sink and checkpoint."""
    source, path, checkpoint = (scratch_path(t.spark, f"{name}{x}") for x in ("-source", "", "-checkpoint"))
    ordered.rocksdb(t.spark)
    low, high = _span(rows)
    late = (high - low) // 20 + 1
    for _ in _arrivals(t, rows, source, late):
        stream = files.read_change_log(t.spark, source, rows.schema, stream=True)
        streams.write_batches(query(stream, f"{late // 1_000_000 + 2} seconds"), path, checkpoint, mode="append").awaitTermination()
    return path, checkpoint


def incidents_stream(t: Tables):
    """Network incidents from intervals that arrive late and out of order."""
    rows = t.n_kpis.select("site_id", "ts", "availability_pct", "drop_call_rate_pct")
    path, checkpoint = _streamed(t, rows, network.bad_runs_stream, "incidents")
    runs = t.spark.read.parquet(path).drop(streams.VERSION)
    runs = runs.unionByName(network.bad_runs_open(t.spark, checkpoint))
    return network.describe_incidents(runs, t.n_sites, rows.agg(F.max("ts").alias("ts")).scalar(), outage_below=85)


def vibration_scored_stream(t: Tables):
    """Sensor readings that arrive late and out of order, scored when they are final."""
    rows = t.f_readings.select("machine_id", "ts", "vibration_rms", "temperature_c")
    base = staged(factory.vibration_baseline(rows), "baseline")
    path, _ = _streamed(
        t, rows,
        lambda stream, lateness: factory.vibration_scored_stream(stream, base, lateness, alert_z=0.5, alert_rows=4, watch_z=0.2, watch_rows=3),
        "scored",
    )
    return t.spark.read.parquet(path).drop(streams.VERSION)


def _history(rows, key: str, wrong: dict, ghost) -> list:
    """Three batches of changes that end in `rows`: a quarter of the rows come late, half are wrong at first, copies of a
    quarter under a key of their own appear and go again, and the last batch repeats old images.
    """
    picked = rows.withColumn("__pick", F.pmod(F.xxhash64(key), F.lit(4)))
    plain, extra = {}, {key: ghost}

    def batch(changes: dict[int, tuple]):
        """One pass: the rows picked, each with its kind, sequence and the columns that differ."""

        def case(values: dict, otherwise):
            return reduce(lambda rest, p: F.when(F.col("__pick") == p, values[p]).otherwise(rest), values, otherwise)

        columns = [case({p: new[c] for p, (_, _, new) in changes.items() if c in new}, F.col(c)).alias(c) for c in rows.columns]
        kind, sequence = (case({p: F.lit(x[i]) for p, x in changes.items()}, F.lit(None)) for i in range(2))
        some = picked.where(F.col("__pick").isin([*changes]))
        return some.select(*columns, kind.alias("change"), sequence.cast("long").alias("sequence"))

    return [
        batch({0: ("insert", 10, plain), 1: ("insert", 10, wrong), 2: ("insert", 10, wrong)}),
        batch({3: ("insert", 20, plain), 1: ("update", 20, plain), 0: ("insert", 20, extra)}),
        batch({2: ("update", 30, plain), 0: ("delete", 30, extra), 1: ("update", 5, wrong)}),
    ]


def revenue_histories(t: Tables) -> dict:
    """Change batches of the base tables behind daily revenue."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    more = {"amount_in_cents": F.col("amount_in_cents") + 7}
    orders = t.s_orders.select(F.col("id").alias("order_id"), F.to_date("created_at").alias("order_date"), "total_in_cents")
    items = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), line.alias("item_id"), F.col("l_partkey").alias("menu_item_id"),
        F.col("l_quantity").cast("long").alias("quantity"), cents.alias("price_in_cents"),
    )
    refunds = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("order_id"), line.alias("refund_id"), F.when(F.col("l_linestatus") == "F", "approved").otherwise("pending").alias("status"),
        F.round(F.col("l_extendedprice") * F.col("l_tax") * 100).cast("long").alias("amount_in_cents"),
    )
    credits = t.lineitem.select(
        line.alias("credit_id"), F.to_date("l_shipdate").alias("order_date"),
        F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long").alias("amount_in_cents"),
    )
    return {
        "orders": _history(orders, "order_id", {"order_date": F.date_add("order_date", 1), "total_in_cents": F.col("total_in_cents") + 100}, F.col("order_id") + 1_000_000_000),
        "items": _history(items, "item_id", {"quantity": F.col("quantity") + 1, "menu_item_id": F.col("menu_item_id") + 1}, F.concat(F.col("item_id"), F.lit("x"))),
        "refunds": _history(refunds, "refund_id", {"status": F.lit("approved"), **more}, F.concat(F.col("refund_id"), F.lit("x"))),
        "credits": _history(credits, "credit_id", {"order_date": F.date_sub("order_date", 2), **more}, F.concat(F.col("credit_id"), F.lit("x"))),
    }


def maintained_revenue(t: Tables):
    """Daily revenue after three batches of changes, each worked in by its signed rows."""
    menu = staged(t.s_menu.select(F.col("id").alias("menu_item_id"), "category"), "menu")
    view = support_live.DailyRevenue(t.spark, scratch_path(t.spark, "revenue"), menu, buckets=8)
    batches = revenue_histories(t)
    for i in range(3):
        view.apply(i, {name: found[i] for name, found in batches.items()})
    return view.current()


SQL_DAILY = """SELECT id, CAST(_timestamp AS DATE) AS day, count(*) AS events, sum(CAST(round(amount * 100) AS BIGINT)) AS cents
    FROM {c_changes} WHERE _pg_change_type <> 'delete' GROUP BY ALL"""


def newer_orders(t: Tables):
    """Incoming rows: urgent orders again with a higher price, and customers as new keys."""
    again = t.orders.where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice")
    )
    fresh = t.customer.select(
        (F.col("c_custkey") + 1_000_000_000).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("o_totalprice")
    )
    return again.unionByName(fresh)


def upserted_table(t: Tables):
    """A written table after an upsert whose source lacks a column."""
    target = scratch_path(t.spark, "orders")
    kept_orders(t).write.parquet(target)
    tables.upsert_table(t.spark, target, newer_orders(t).drop("o_custkey"), ["o_orderkey"])
    return t.spark.read.parquet(target)


def compacted_state(t: Tables):
    """Current state kept in three batches by hash of the event, folded before the last one is read."""
    path = scratch_path(t.spark, "versions")
    for batch in range(3):
        part = t.c_changes.where(F.pmod(F.col("_pg_lsn"), F.lit(3)) <= batch)
        cdc.latest_changes(part, CHANGES).write.parquet(f"{path}/{streams.VERSION}={batch}")
    streams.compact_versions(t.spark, path, CHANGES.keys)
    return streams.scd1_current(t.spark, path, CHANGES)


def csv_orders(t: Tables):
    """Orders written as compressed CSV and read back."""
    root = scratch_path(t.spark, "csv")
    t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").write.option("compression", "gzip").csv(f"{root}/orders.csv.gz", header=True)
    return files.read_csv_any(t.spark, root, "orders")


def kept_orders(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


SQL_NEWER = """SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM {orders} WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT c_custkey + 1000000000, c_custkey, c_acctbal FROM {customer}"""
ORDER_COLUMNS = "o_orderkey:b o_custkey:b o_totalprice:d2"

ENTRIES = [
    Entry("scd1_state", "id:b status:s amount:d2", lambda t: cdc.current_state(t.c_changes, CHANGES), SQL_STATE),
    Entry("scd1_stream", "id:b status:s amount:d2", scd1_stream, SQL_STATE),
    Entry("refreshed_view", "id:b status:s amount:d2", refreshed_view, SQL_STATE),
    Entry("compacted_state", "id:b status:s amount:d2", compacted_state, SQL_STATE),
    Entry("read_csv_any", "o_orderkey:b o_orderstatus:s o_orderpriority:s", csv_orders, "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM {orders}"),
    Entry(
        "upsert_table",
        "o_orderkey:b o_custkey:b o_totalprice:d2",
        upserted_table,
        """SELECT o_orderkey, o_custkey, o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS o_totalprice FROM {orders}
        UNION ALL SELECT c_custkey + 1000000000, NULL, c_acctbal FROM {customer}""",
    ),
    Entry(
        "delete_from_time_parents",
        "o_orderkey:b o_custkey:b",
        lambda t: maintenance.delete_from_time(
            t.orders, t.lineitem, "o_custkey", "o_orderdate",
            t.events.groupBy(F.col("user_id").alias("o_custkey")).agg(F.lit("1999-01-01").cast("timestamp_ntz").alias("cut")),
            "o_orderkey", "l_orderkey",
        )[0],
        """SELECT o_orderkey, o_custkey FROM {orders} WHERE NOT (o_orderdate >= TIMESTAMP '1999-01-01' AND o_custkey IN (SELECT user_id FROM {events}))""",
    ),
    Entry("incidents_stream", INCIDENT_COLUMNS, incidents_stream, SQL_INCIDENTS),
    Entry("vibration_scored_stream", "machine_id:b ts:t baseline:d4 z:d4 alert_hour:B watch_hour:B", vibration_scored_stream, SQL_SCORED),
    Entry("maintained_revenue", DAILY_REVENUE_COLUMNS, maintained_revenue, SQL_DAILY_REVENUE),
    Entry("daily_totals_windows", "id:b day:D events:b cents:b", daily_windows, SQL_DAILY),
    Entry("daily_totals_stream", "id:b day:D events:b cents:b", daily_stream, SQL_DAILY),
    Entry(
        "daily_totals_net",
        "id:b day:D cents:b",
        lambda t: cdc.daily_totals(
            t.c_changes.withColumn("at", F.col("_timestamp")), ["id"], "at", "day",
            {"cents": F.round(F.col("amount") * 100).cast("long")}, CHANGES, net_updates=True,
        ),
        """SELECT id, CAST(_timestamp AS DATE) AS day, CAST(round(amount * 100) AS BIGINT) AS cents FROM {c_changes}
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY _pg_lsn DESC) = 1 AND _pg_change_type <> 'delete'""",
    ),
    Entry(
        "upsert",
        ORDER_COLUMNS,
        lambda t: maintenance.upsert(kept_orders(t), newer_orders(t), ["o_orderkey"]),
        f"""SELECT * FROM ({SQL_NEWER}) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM {{orders}}
        WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({SQL_NEWER}))""",
    ),
    Entry(
        "insert_new",
        ORDER_COLUMNS,
        lambda t: maintenance.insert_new(kept_orders(t), newer_orders(t), ["o_orderkey"]),
        "SELECT c_custkey + 1000000000 AS o_orderkey, c_custkey AS o_custkey, c_acctbal AS o_totalprice FROM {customer}",
    ),
    Entry(
        "update_by_key",
        "o_orderkey:b o_orderstatus:s o_totalprice:d2",
        lambda t: maintenance.update_by_key(
            t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"),
            t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n")),
            ["o_orderkey"],
            {"o_orderstatus": F.when(F.col("new.n") > 2, "R").otherwise(F.col("o_orderstatus")), "o_totalprice": F.greatest(F.lit(0.0), F.col("o_totalprice") - F.col("new.n") * 1000)},
        ),
        """SELECT o_orderkey, CASE WHEN n > 2 THEN 'R' ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN n IS NULL THEN o_totalprice ELSE greatest(0, o_totalprice - n * 1000) END AS o_totalprice FROM {orders}
        LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""",
    ),
    Entry(
        "delete_by_key",
        "o_orderkey:b",
        lambda t: maintenance.delete_by_key(
            t.orders.select("o_orderkey"), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]
        ),
        "SELECT o_orderkey FROM {orders} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R')",
    ),
    Entry(
        "delete_from_time",
        "l_orderkey:b lines:b",
        lambda t: maintenance.delete_from_time(
            t.orders, t.lineitem, "o_custkey", "o_orderdate",
            t.events.groupBy(F.col("user_id").alias("o_custkey")).agg(F.lit("1999-01-01").cast("timestamp_ntz").alias("cut")),
            "o_orderkey", "l_orderkey",
        )[1].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines")),
        """SELECT l_orderkey, count(*) AS lines FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders}
        WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_custkey IN (SELECT user_id FROM {events})) GROUP BY 1""",
    ),
    Entry(
        "guarded_insert",
        "event_id:b user_id:b",
        lambda t: maintenance.guarded_insert(
            t.events.select("event_id", "user_id"), t.orders.where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("user_id")), ["user_id"]
        ),
        "SELECT event_id, user_id FROM {events} WHERE user_id IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '5-LOW')",
    ),
]
