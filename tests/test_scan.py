"""Split scans equal plain ones: every operator with all keys treated as hot."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import hotkeys, joins, scan, windows

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def steps(spark):
    """A skewed table: key 0 has a third of the rows, several share an instant."""
    rng = random.Random(11)
    data = []
    for i in range(900):
        key = 0 if i % 3 == 0 else rng.randrange(1, 40)
        ts = START + dt.timedelta(hours=rng.randrange(24 * 12))
        data.append((i, key, ts, rng.randrange(100), rng.random() < 0.5))
    return spark.createDataFrame(data, "id long, k long, ts timestamp_ntz, v long, flag boolean").cache()


def test_hot_keys_are_few_and_large(steps):
    assert [r.k for r in hotkeys.hot_keys(steps, ["k"], 200).keys] == [0]
    assert not hotkeys.hot_keys(steps, ["k"], 10_000)
    assert not hotkeys.hot_keys(steps, ["k"], None)


def test_hot_keys_cannot_exceed_their_bound(spark):
    many = spark.range(100_001).select(F.col("id").alias("k"))
    assert not hotkeys.hot_keys(many, ["k"], 1)
    fewer = many.union(spark.range(1).select(F.lit(5).cast("long").alias("k")))
    assert [r.k for r in hotkeys.hot_keys(fewer, ["k"], 1).keys] == [5]


def test_null_keys_are_split(spark):
    df = spark.range(1_000).select(F.when(F.col("id") % 2 == 0, F.lit(1)).alias("k"), F.col("id").alias("at"), F.lit(1).alias("v"))
    hot = hotkeys.hot_keys(df, ["k"], 100)
    assert {r.k for r in hot.keys} == {None, 1}
    summed = scan.running(df, ["k"], ["at"], {"n": scan.total(F.col("v"))}, hot=hot)
    assert {(r.k, r.at, r.n) for r in summed.collect()} == {(1 if i % 2 == 0 else None, i, i // 2 + 1) for i in range(1_000)}


@pytest.mark.parametrize("kind", ["timestamp", "string", "ties"])
def test_chunks_follow_rows_and_not_values(spark, kind):
    base = spark.range(20_001).select(F.lit("x").alias("k"), F.col("id"))
    stray = F.when(F.col("id") == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.timestamp_seconds(1_700_000_000 + F.col("id")))
    at = {"timestamp": stray, "string": F.lpad(F.col("id").cast("string"), 9, "0"), "ties": F.lit(7)}[kind]
    df = base.withColumn("at", at)
    hot = hotkeys.hot_keys(df, ["k"], 1_000)
    chunks = hotkeys.with_chunks(df, ["k"], ["at", "id"], hot)
    sizes = chunks.groupBy(hotkeys.CHUNK).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect()
    assert len(sizes) > 15 and max(r.n for r in sizes) <= 2_000
    assert [r[hotkeys.CHUNK] for r in sizes] == sorted(r[hotkeys.CHUNK] for r in sizes)
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:], strict=False))


@pytest.mark.parametrize("hot", [1, 60, None])
def test_rolling_rows(steps, hot):
    order = [F.col("ts"), F.col("id")]
    frame = Window.partitionBy("k").orderBy(*order).rowsBetween(-4, 0)
    expected = steps.select("id", F.sum("v").over(frame).alias("s"), F.count(F.lit(1)).over(frame).alias("n"))
    found = windows.rolling_rows(steps, ["k"], ["ts", "id"], 4, {"s": F.sum("v"), "n": F.count(F.lit(1))}, hot=hot)
    assert rows(found, "id", "s", "n") == rows(expected)


def test_attach_equals_join(steps):
    per_key = steps.groupBy("k").agg(F.sum("v").alias("total"))
    hot = hotkeys.hot_keys(steps, ["k"], 200)
    assert rows(hotkeys.attach(steps, per_key, ["k"], hot)) == rows(steps.join(per_key, "k"))


@pytest.mark.parametrize("hot", [1, 60, None])
@pytest.mark.parametrize("descending", [False, True])
def test_running(steps, hot, descending):
    order = [F.col(c).desc() if descending else F.col(c) for c in ("ts", "id")]
    upto = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = F.when(F.col("flag"), F.col("v"))
    expected = steps.select(
        "id",
        F.sum("v").over(upto).alias("a"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("b"),
        F.last(marked, ignorenulls=True).over(upto).alias("c"),
        F.last(marked, ignorenulls=True).over(before).alias("d"),
    )
    scans = {
        "a": scan.total(F.col("v")),
        "b": scan.total(F.col("v"), strict=True),
        "c": scan.last(marked),
        "d": scan.last(marked, strict=True),
    }
    out = scan.running(steps, ["k"], ["ts", "id"], scans, descending=descending, hot=hot)
    assert rows(out, "id", "a", "b", "c", "d") == rows(expected)
    assert out.columns == [*steps.columns, "a", "b", "c", "d"]


def test_running_by_number_and_two_keys(steps):
    w = Window.partitionBy("k", "flag").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    expected = steps.select("id", F.sum("v").over(w).alias("a"))
    out = scan.running(steps, ["k", "flag"], ["v", "id"], {"a": scan.total(F.col("v"))}, hot=1)
    assert rows(out, "id", "a") == rows(expected)


@pytest.mark.parametrize("hot", [1, None])
def test_trailing_span_is_a_range_frame(spark, steps, hot):
    steps.createOrReplaceTempView("steps")
    expected = spark.sql(
        """SELECT DISTINCT k, ts, count(*) OVER w n, sum(v) OVER w s FROM steps
        WINDOW w AS (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL 30 HOURS PRECEDING AND CURRENT ROW)"""
    )
    out = windows.trailing_span(steps, ["k"], "ts", "30 hours", {"n": F.lit(1), "s": F.col("v")}, hot)
    assert rows(out) == rows(expected)


@pytest.mark.parametrize("hot", [1, None])
def test_run_lengths_are_full_row_frames(steps, hot):
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-3, 0)
    expected = steps.select("id", (F.sum(F.when(F.col("flag"), 1).otherwise(0)).over(w) == 4).alias("x"))
    out = windows.run_lengths(steps, ["k"], ["ts", "id"], {"n": F.col("flag")}, hot)
    assert rows(out.select("id", (F.col("n") >= 4).alias("x"))) == rows(expected)


@pytest.mark.parametrize("hot", [1, None])
@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_nearest_mark(steps, hot, forward, strict):
    data = [tuple(r) for r in steps.collect()]
    marks = [(k, ts) for _, k, ts, _, flag in data if flag]
    out = joins.nearest_mark(
        steps.select("k", "ts", "id"), steps.where("flag").select("k", "ts"), ["k"], "ts", "m", forward, strict, hot=hot
    )
    found = {r["id"]: r["m"] for r in out.collect()}
    for i, k, ts, _, _ in data:
        if forward:
            near = [m for mk, m in marks if mk == k and (m > ts or (m == ts and not strict))]
            assert found[i] == (min(near) if near else None)
        else:
            near = [m for mk, m in marks if mk == k and (m < ts or (m == ts and not strict))]
            assert found[i] == (max(near) if near else None)


def test_nearest_mark_payload(steps):
    out = joins.nearest_mark(
        steps.select("k", "ts", "id"), steps.select("k", "ts", "v"), ["k"], "ts", "m", forward=False, payload=["v"]
    )
    assert out.where(F.col("m.ts") != F.col("ts")).count() == 0
    assert out.where(F.col("m.v").isNull()).count() == 0


@pytest.mark.parametrize("hot", [1, None])
@pytest.mark.parametrize("include_lo", [True, False])
def test_interval_totals(steps, hot, include_lo):
    data = [tuple(r) for r in steps.collect()]
    out = joins.interval_totals(
        steps.where("flag"), steps, ["k"], "ts", ["id"], F.col("ts"), F.col("ts") + F.expr("INTERVAL 20 HOURS"),
        {"s": F.col("v"), "n": F.lit(1)}, include_lo, hot=hot,
    )
    found = {r["id"]: (r["s"], r["n"]) for r in out.collect()}
    for i, k, ts, _, flag in data:
        if flag:
            hi = ts + dt.timedelta(hours=20)
            inside = [x for x in data if x[1] == k and (ts < x[2] <= hi or (include_lo and x[2] == ts))]
            assert found[i] == (sum(x[3] for x in inside), len(inside))


def test_interval_join_edges(spark):
    t = lambda s: START + dt.timedelta(seconds=s)
    points = spark.createDataFrame([(1, t(s)) for s in (0, 59, 60, 120, 121)], "k long, ts timestamp_ntz")
    spans = spark.createDataFrame([(1, t(60), t(120)), (2, t(0), t(500))], "k long, lo timestamp_ntz, hi timestamp_ntz")
    for width in (7, 60, 86_400):
        assert rows(joins.interval_join(points, spans, ["k"], "ts", "lo", "hi", width), "ts") == [(t(60),), (t(120),)]
    assert joins.interval_join(points, spans, ["k"], "ts", "lo", "hi", 7, "left_anti").count() == 3


@pytest.mark.parametrize("hot", [1, None])
def test_islands_ignore_missing_time_unless_asked(spark, hot):
    t = lambda h: START + dt.timedelta(hours=h)
    data = [("a", t(0), True), ("a", t(1), True), ("a", t(30), True), ("a", t(31), False), ("a", t(32), True), ("b", t(0), True)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, bad boolean")
    aggs = [F.min("ts").alias("s"), F.max("ts").alias("e"), F.count(F.lit(1)).alias("n")]
    plain = windows.islands(df, ["k"], ["ts"], F.col("bad"), aggs, hot=hot)
    assert rows(plain) == sorted([("a", t(0), t(30), 3), ("a", t(32), t(32), 1), ("b", t(0), t(0), 1)], key=repr)
    gapped = windows.islands(df, ["k"], ["ts"], F.col("bad"), aggs, min_rows=2, max_gap="2 hours", hot=hot)
    assert rows(gapped) == [("a", t(0), t(1), 2)]


def test_paged_lists_and_threads_keep_everything(steps):
    whole = {r.k: r.ids for r in steps.groupBy("k").agg(F.sort_array(F.collect_set("id")).alias("ids")).collect()}
    for hot in (1, None):
        pages = windows.paged_lists(steps, ["k"], "id", "ids", page_size=50, hot=hot).collect()
        for k, ids in whole.items():
            mine = [r.ids for r in sorted(pages, key=lambda r: r.page) if r.k == k]
            assert [x for p in mine for x in p] == ids
            assert [len(p) for p in mine[:-1]] == [50] * (len(mine) - 1)
    lines = windows.threads(steps, ["k"], ["ts", "id"], F.col("id").cast("string"), "text", page_rows=25, hot=1)
    joined = {}
    for r in sorted(lines.collect(), key=lambda r: (r.k, r.page)):
        joined.setdefault(r.k, []).extend(r.text.split("\n"))
    ordered = {}
    for r in steps.orderBy("k", "ts", "id").collect():
        ordered.setdefault(r.k, []).append(str(r.id))
    assert joined == ordered


def test_flag_exists_and_pick_child(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "p long")
    children = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 1, "z")], "p long, at long, name string")
    assert rows(joins.flag_exists(parents, children, ["p"], "has")) == [(1, True), (2, True), (3, False)]
    assert rows(joins.pick_child(parents, children, ["p"], ["at"], ["name"])) == [(1, "y"), (2, "z"), (3, None)]
    assert rows(joins.pick_child(parents, children, ["p"], ["at"], ["name"], newest=False)) == [(1, "x"), (2, "z"), (3, None)]
    assert rows(joins.orphans(children, parents.where("p = 1"), ["p"]), "name") == [("z",)]
    dim = joins.complete_dimension(parents, children.groupBy("p").agg(F.count(F.lit(1)).alias("n")), ["p"], {"n": 0})
    assert rows(dim) == [(1, 2), (2, 1), (3, 0)]
