"""Change histories: current state per key, and aggregates over change rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The metadata columns of a change-history row.
CHANGE_META = ["_pg_change_type", "_pg_lsn", "_pg_xid", "_timestamp", "_sort_by"]


@dataclass(frozen=True)
class ChangeSpec:
    """How to read a change history.

    `sequence` orders the changes of a key; columns after the first break ties, which the first alone
    leaves undefined.
    """

    keys: list[str]
    sequence: list[str] = field(default_factory=lambda: ["_pg_lsn"])
    operation: str = "_pg_change_type"
    delete_value: str = "delete"
    meta: list[str] = field(default_factory=lambda: list(CHANGE_META))

    def deleted(self) -> Column:
        return F.coalesce(F.col(self.operation) == self.delete_value, F.lit(False))


def latest_changes(changes: DataFrame, spec: ChangeSpec) -> DataFrame:
    """The change with the highest sequence per key, deletes included (tombstones).

    An aggregate that merges before the shuffle, valid on batch and streaming input alike.
    """
    newest = F.max_by(F.struct("*"), F.struct(*spec.sequence)).alias("__row")
    return changes.groupBy(*[F.col(k).alias(f"__{k}") for k in spec.keys]).agg(newest).select("__row.*")


def drop_deleted(latest: DataFrame, spec: ChangeSpec) -> DataFrame:
    """Live rows without the metadata columns."""
    return latest.where(~spec.deleted()).drop(*spec.meta, spec.operation, *spec.sequence)


def current_state(changes: DataFrame, spec: ChangeSpec) -> DataFrame:
    """Current rows per key: highest sequence wins, a delete removes, lower sequences never return."""
    return drop_deleted(latest_changes(changes, spec), spec)


def daily_totals(
    changes: DataFrame,
    keys: list[str],
    ts: str,
    day: str,
    measures: dict[str, Column],
    spec: ChangeSpec,
    net_updates: bool = False,
) -> DataFrame:
    """Sums per key and day over change rows that are not deletes.

    As asked for by default, every image of an updated row is added. `net_updates` reduces the
    history to current rows first. Works on streaming input with net_updates=False.
    """
    rows = current_state(changes, spec) if net_updates else changes.where(~spec.deleted())
    return rows.groupBy(*keys, F.to_date(ts).alias(day)).agg(*[F.sum(m).alias(n) for n, m in measures.items()])


def unanswered(
    messages: DataFrame, cases: DataFrame, responses: DataFrame, open_states: tuple[str, ...] = ("open", "in_progress")
) -> DataFrame:
    """The newest customer message without a response, per open case: the next batch of work.

    Answered messages leave before the ranking, so an older unanswered one can surface, and an admin
    reply does not hide a customer message. Running it again after responses are stored gives only
    what is still missing.
    """
    waiting = (
        messages.where(F.col("admin_id").isNull())
        .join(responses.select(F.col("message_id").alias("id")), "id", "left_anti")
        .groupBy("case_id")
        .agg(F.max_by("id", F.struct("created_at", "id")).alias("message_id"))
    )
    live = cases.where(F.col("status").isin(list(open_states)))
    return waiting.join(live.withColumnRenamed("id", "case_id"), "case_id").select(
        "message_id", "case_id", "user_id", "subject", "status"
    )
