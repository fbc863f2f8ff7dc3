"""Streams whose rows arrive out of order, worked on in event-time order per key.

A key's rows wait in state until the watermark has passed them and are then handed on in order, once. What has to be
remembered between rows is one small record per key: an open island, or the lengths of the runs so far. Timers do
both jobs: the earliest waiting row sets one, so rows go on as soon as they are final, and an open island sets one
for the instant at which the gap after its last row is too long, so it closes although no row comes.

Keys are dealt by hash to `groups`, and a group has its state calls and its timer in common: a call costs as much as
many rows, so keys must not each have their own. For the same reason rows come to the state, lie there and are worked on
as Arrow pages of many rows: each task deals what it reads to pages, one per group. State per key is the rows within the
lateness and that one record; a task holds one group at a time, so there should be more groups where many keys have many
waiting rows. Spark drops a page when all its rows are behind the watermark; of other pages a row is dropped when its
group has been worked through past the row's time. A row whose key is NULL is a heartbeat: it moves the watermark and
belongs to nothing. Use the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State variables, as the state reader knows them.
MEMORY, WAITING, DUE = "memory", "waiting", "due"
#: The group of a key, how many groups there are, the rows of one stored page, and the bytes a task deals at a time.
GROUP, GROUPS, PAGE, DEALT = "__group", 1_024, 10_000, 64_000_000


def rocksdb(spark: SparkSession) -> None:
    """Use the state store that keyed state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _dealer(keys: list[str]):
    """Rows with their group to one page per group, with the latest time in it; rows without a key add their time only."""

    def page(rows: pa.Table) -> bytes | None:
        unknown = np.zeros(len(rows), dtype=bool)
        for k in keys:
            unknown |= pc.is_null(rows[k], nan_is_null=True).to_numpy()
        known = rows.filter(pa.array(~unknown)) if unknown.any() else rows
        if known["at"].null_count:
            raise ValueError("a row without a time has no place in the order")
        return _packed(known) if len(known) else None

    def deal(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        group = rows[GROUP].to_numpy()
        order = np.argsort(group, kind="stable")
        rows, group = rows.drop_columns([GROUP]).take(order).combine_chunks(), group[order]
        cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
        parts = [rows.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]
        made = [pa.array(group[cuts[:-1]]), pa.array([pc.max(p["at"]).as_py() for p in parts], pa.int64()), pa.array(map(page, parts), pa.binary())]
        return pa.RecordBatch.from_arrays(made, [GROUP, "latest", "page"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= DEALT:
                yield deal(held)
                held = []
        if held:
            yield deal(held)

    return run


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(page: bytes) -> pa.Table:
    return pa.ipc.open_stream(page).read_all()


class InOrder(StatefulProcessor):
    """Gives a group's rows to `advance` in order of (keys, at, tie, ...), after the watermark has passed them.

    `columns` are the columns that a row keeps besides its `keys`, the first one `at`, microseconds of event time.
    `record` is what a key remembers, `out` the names that are emitted after the keys.
    """

    def __init__(self, keys: T.StructType, columns: T.StructType, record: T.StructType, out: list[str], spark: SparkSession):
        self.keys, self.columns, self.record, self.out = keys, columns, record, out
        self.kept = spark.createDataFrame([], T.StructType([*keys, *columns])).toArrow().schema
        self.known = spark.createDataFrame([], T.StructType([*keys, *record])).toArrow().schema

    def advance(self, memory: pa.Table, rows: pa.Table, passed: int) -> tuple[pa.Table, pa.Table]:
        """The records of the group's keys after their final rows and all deadlines up to `passed`; and rows to emit."""
        raise NotImplementedError

    def deadline(self, memory: pa.Table) -> int | None:
        """The first event time, in microseconds, at which a record is over unless a row comes; None for never."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getListState(MEMORY, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in [*self.keys, *self.record]]))
        self.waiting = handle.getListState(WAITING, T.StructType([T.StructField("page", T.BinaryType())]))
        self.due = handle.getValueState(DUE, T.StructType([T.StructField("ms", T.LongType()), T.StructField("passed", T.LongType())]))

    def _due(self) -> tuple[int | None, int | None]:
        """When the timer is set for, and up to what time the group has been worked through."""
        return tuple(self.due.get()) if self.due.exists() else (None, None)

    def _wake(self, at: int, ms: int | None, passed: int | None) -> None:
        """Set a timer for `at` unless an earlier one is set."""
        wanted = -(-at // 1_000)
        if ms is None or ms > wanted:
            self.handle.registerTimer(wanted)
            self.due.update((wanted, passed))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ms, passed = self._due()
        pages, earliest = [], []
        for frame in rows:
            for page in frame["page"]:
                if page is None:
                    continue
                times = _unpacked(page)["at"].to_numpy()
                if passed is not None and times.min() <= passed:
                    page, times = _packed(_unpacked(page).filter(pa.array(times > passed))), times[times > passed]
                if len(times):
                    pages.append((bytes(page),))
                    earliest.append(int(times.min()))
        if pages:
            self.waiting.appendList(pages)
            self._wake(min(earliest), ms, passed)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed, (ms, _) = timerValues.getCurrentWatermarkInMs() * 1_000, self._due()
        if ms is None or ms > expiredTimerInfo.getExpiryTimeInMs():
            return
        rows = pa.concat_tables([self.kept.empty_table(), *(_unpacked(page).select(self.kept.names).cast(self.kept) for (page,) in self.waiting.get())])
        done = pc.less_equal(rows["at"], passed)
        final, left = rows.filter(done), rows.filter(pc.invert(done))
        pages = [pa.table([pa.array(c, f.type) for c, f in zip(page, self.known, strict=True)], schema=self.known) for page in self.memory.get()]
        before = pa.concat_tables([self.known.empty_table(), *pages])
        after, emitted = self.advance(before, final.sort_by([(n, "ascending") for n in self.kept.names]), passed)
        if len(final):
            self.waiting.clear()
            if len(left):
                self.waiting.put([(_packed(left.slice(i, PAGE)),) for i in range(0, len(left), PAGE)])
        if not after.equals(before):
            self.memory.clear()
            if len(after):
                self.memory.put([tuple(c.to_pylist() for c in after.slice(i, PAGE).columns) for i in range(0, len(after), PAGE)])
        self.due.update((None, passed))
        following = [x for x in (pc.min(left["at"]).as_py(), self.deadline(after)) if x is not None]
        if following:
            self._wake(min(following), None, passed)
        for first in range(0, len(emitted), PAGE):
            yield emitted.slice(first, PAGE).to_pandas(integer_object_nulls=True)

    def _joined(self, memory: pa.Table, rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """Every key's record, if it has one, before its rows; and where the next key begins."""
        both = pa.concat_tables([memory, rows], promote_options="default")
        both = both.append_column("place", pa.array(np.arange(len(both))))
        both = both.sort_by([(n, "ascending") for n in [*self.keys.names, "place"]]).combine_chunks()
        begins = np.zeros(len(both), dtype=bool)
        begins[:1] = True
        for k in self.keys.names:
            begins[1:] |= pc.not_equal(both[k][1:], both[k][:-1]).to_numpy()
        return both, begins

    def close(self) -> None:
        pass


class _Islands(InOrder):
    """Runs of consecutive flagged rows. The record: first, last, rows, and one value per measure."""

    def __init__(
        self, keys: T.StructType, columns: T.StructType, record: T.StructType, spark: SparkSession, kinds: dict[str, str], min_rows: int, gap: int | None
    ):
        super().__init__(keys, columns, record, record.names, spark)
        self.kinds, self.min_rows, self.gap = kinds, min_rows, gap

    def advance(self, memory: pa.Table, rows: pa.Table, passed: int) -> tuple[pa.Table, pa.Table]:
        ones = pa.array(np.ones(len(rows), dtype=np.int64))
        single = rows.select([*self.keys.names, "at", "at", "flagged", *self.kinds]).rename_columns([*self.keys.names, "first", "last", "flagged", *self.kinds])
        both, begins = self._joined(
            memory.append_column("flagged", pa.array(np.ones(len(memory), dtype=bool))), single.append_column("rows", ones)
        )
        flagged, first, last = (both[n].to_numpy() for n in ("flagged", "first", "last"))
        fresh = begins | ~flagged
        fresh[1:] |= ~flagged[:-1]
        if self.gap is not None:
            fresh[1:] |= first[1:] > last[:-1] + self.gap
        # the last row of each run, and whether a row of the same key follows it
        ends = np.append(fresh[1:], True)[: len(both)]
        followed = np.append(~begins[1:], False)[: len(both)]
        numbered = both.append_column("run", pa.array(np.cumsum(fresh))).filter(pa.array(flagged))
        wanted = {"last": "max", "rows": "sum", **self.kinds}
        # the first row of a run has its keys and its start
        heads = both.filter(pa.array(fresh & flagged)).select([*self.keys.names, "first"])
        found = numbered.group_by("run", use_threads=False).aggregate([(n, kind) for n, kind in wanted.items()]).sort_by("run")
        columns = [*heads.columns, *(found[f"{n}_{kind}"].cast(self.known.field(n).type) for n, kind in wanted.items())]
        runs = pa.table(columns, schema=self.known)
        open_ = ~followed[ends & flagged]
        if self.gap is not None:
            open_ &= runs["last"].to_numpy() + self.gap + 1 > passed
        closed = ~open_ & (runs["rows"].to_numpy() >= self.min_rows)
        return runs.filter(pa.array(open_)).combine_chunks(), runs.filter(pa.array(closed))

    def deadline(self, memory: pa.Table) -> int | None:
        return None if self.gap is None or not len(memory) else pc.min(memory["last"]).as_py() + self.gap + 1


class _RunLengths(InOrder):
    """Every row with the lengths of its runs. The record: one length per flag."""

    def advance(self, memory: pa.Table, rows: pa.Table, passed: int) -> tuple[pa.Table, pa.Table]:
        both, begins = self._joined(memory, rows)
        held = both["at"].is_null().to_numpy()
        index = np.arange(len(both))
        for name in self.record.names:
            on = pc.fill_null(both[f"on_{name}"], True).to_numpy()
            # a record counts for as many rows as it remembers
            weight = np.where(held, pc.fill_null(both[name], 0).to_numpy(), on)
            total = np.cumsum(weight)
            start = np.where(on, total - weight, total)
            since = np.maximum.accumulate(np.where(begins | ~on, index, 0))
            lengths = pa.array((total - start[since]).astype(np.int64))
            both = both.set_column(both.column_names.index(name), name, lengths)
        final = np.append(begins[1:], True)[: len(both)]
        emitted = both.filter(pa.array(~held)).select([*self.keys.names, *self.out])
        return both.filter(pa.array(final)).select(self.known.names).cast(self.known).combine_chunks(), emitted


def _prepared(rows: DataFrame, keys: list[str], ts: str, columns: dict[str, Column]) -> DataFrame:
    return rows.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), *[c.alias(n) for n, c in columns.items()])


def _struct(rows: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names])


def _at(micros: str) -> Column:
    """Microseconds as a timestamp without zone."""
    return F.timestamp_micros(F.col(micros)).cast("timestamp_ntz")


def islands_stream(
    rows: DataFrame, keys: list[str], ts: str, flag: Column, measures: dict[str, tuple[str, Column]], lateness: str,
    tie: list[str] | None = None, min_rows: int = 1, max_gap: str | None = None, groups: int = GROUPS,
) -> DataFrame:
    """Closed runs of at least `min_rows` consecutive flagged rows: (keys, started_at, last_ts, rows, measures).

    The streaming form of `windows.islands`: rows count in event-time order (equal instants by `tie`), whatever the order
    of arrival within `lateness`. A run closes with the next row that is not flagged or, with `max_gap`, as soon as the
    watermark shows that none can follow. `measures` gives each result column as ("min" | "max" | "sum", column). Runs
    that are still open are in the state: see `open_islands`.
    """
    ties = tie or []
    columns = {"flagged": F.coalesce(flag, F.lit(False)), **{f"tie_{t}": F.col(t) for t in ties}, **{n: c for n, (_, c) in measures.items()}}
    prepared = _prepared(rows, keys, ts, columns)
    record = T.StructType([*(T.StructField(n, T.LongType()) for n in ("first", "last", "rows")), *_struct(prepared, list(measures))])
    gap = None if max_gap is None else int(pd.Timedelta(max_gap).total_seconds() * 1_000_000)
    out = T.StructType([*_struct(prepared, keys), *record])
    kept = _struct(prepared, ["at", *(f"tie_{t}" for t in ties), "flagged", *measures])
    made = _Islands(_struct(prepared, keys), kept, record, rows.sparkSession, {n: k for n, (k, _) in measures.items()}, min_rows, gap)
    return _named(_grouped(prepared, keys, lateness, groups).transformWithStateInPandas(made, out, "Append", "EventTime"), keys, list(measures))


def _grouped(prepared: DataFrame, keys: list[str], lateness: str, groups: int) -> GroupedData:
    """Pages of rows by group; the time of a page is its latest, so the watermark is that of the rows."""
    dealt = prepared.withColumn(GROUP, F.pmod(F.xxhash64(*keys), F.lit(groups)))
    pages = dealt.mapInArrow(_dealer(keys), f"{GROUP} long, latest long, page binary")
    return pages.select(GROUP, F.timestamp_micros("latest").alias("event_time"), "page").withWatermark("event_time", lateness).groupBy(GROUP)


def _named(found: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return found.select(*keys, _at("first").alias("started_at"), _at("last").alias("last_ts"), "rows", *measures)


def open_islands(spark: SparkSession, checkpoint: str, measures: list[str], min_rows: int = 1) -> DataFrame:
    """The runs that a stopped `islands_stream` has not closed, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", MEMORY).load(checkpoint)
    columns = state.schema["list_element"].dataType.names
    found = state.select("list_element.*").select(F.inline(F.arrays_zip(*columns)))
    keys = columns[: len(columns) - len(measures) - 3]
    return _named(found.where(F.col("rows") >= min_rows), keys, measures)


def run_lengths_stream(
    rows: DataFrame, keys: list[str], ts: str, flags: dict[str, Column], carried: list[str], lateness: str, groups: int = GROUPS
) -> DataFrame:
    """Every row, once it is final, with how many rows in a row up to it have each flag: (keys, ts, carried, flags).

    The streaming form of `windows.run_lengths`; `carried` columns come along.
    """
    on = {f"on_{n}": F.coalesce(f, F.lit(False)) for n, f in flags.items()}
    prepared = _prepared(rows, keys, ts, {**on, **{c: F.col(c) for c in carried}})
    record = T.StructType([T.StructField(n, T.LongType()) for n in flags])
    names = ["at", *carried, *flags]
    out = T.StructType([*_struct(prepared, [*keys, "at", *carried]), *record])
    made = _RunLengths(_struct(prepared, keys), _struct(prepared, ["at", *on, *carried]), record, names, rows.sparkSession)
    found = _grouped(prepared, keys, lateness, groups).transformWithStateInPandas(made, out, "Append", "EventTime")
    return found.select(*keys, _at("at").alias(ts), *carried, *flags)
