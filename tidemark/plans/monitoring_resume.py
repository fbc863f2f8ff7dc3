"""Nightly detection that reads only new transactions.

A run leaves behind what the next one needs of the past: per rule the rows that a window of a later row can still reach,
with a mark for those already given as evidence; per customer the time of the last row before them; for the rule that
adds up a customer's wires, the running total and the wires that wait for it to reach the minimum; and every summary.
Everything else of the past is closed: no later row can change it.

Transactions of a run must not be older than those of the runs before; equal instants may be split between runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from . import monitoring
from .monitoring import EVIDENCE, OUTGOING, RuleHits

# Columns of a transaction, of kept rows, of marks, of totals, of evidence and of summaries.
TXN = "customer_id long, txn_id long, ts timestamp_ntz, type string, amount_cents long, counterparty_country string"
KEPT = f"{TXN}, given boolean"
MARKS = "customer_id long, ts timestamp_ntz"
TOTALS = "customer_id long, total_cents long"
GIVEN = "customer_id long, txn_id long, ts timestamp_ntz, amount_cents long, incoming boolean"
SUMMARY = "customer_id long, total_cents long, first_ts timestamp_ntz, last_ts timestamp_ntz, n_evidence long"


def _names(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).names


@dataclass(frozen=True)
class WindowRule:
    """A rule whose verdict on a row depends on rows at most `reach` away, and on the row before if it is `quiet`-aware."""

    rule_id: str
    relevant: Column
    reach: str
    run: Callable[[DataFrame], RuleHits]
    quiet: bool = False


@dataclass(frozen=True)
class TotalRule:
    """A rule that flags all relevant rows of a customer once they add up to the minimum."""

    rule_id: str
    relevant: Column
    minimum: int


def standard_rules(
    low: int = 800_000, high: int = 999_999, wire: int = 2_000_000, listed: int = 1_000_000, gap: str = "60 days", wake_span: str = "7 days",
    woken: int = 2_500_000, round_minimum: int = 500_000, unit: int = 100_000, round_count: int = 5, round_span: str = "30 days",
) -> list[WindowRule | TotalRule]:
    """The five rules of `monitoring.run_rules`, with their thresholds."""
    kind, cents = F.col("type"), F.col("amount_cents")
    return [
        WindowRule(
            "STRUCTURING", (kind == "CASH_DEPOSIT") & cents.between(low, high), "7 days",
            lambda rows: monitoring.structuring(rows, low, high),
        ),
        WindowRule("RAPID_MOVEMENT", kind.isin("WIRE_IN", *OUTGOING), "48 hours", lambda rows: monitoring.rapid_movement(rows, wire)),
        TotalRule("HIGH_RISK_JURISDICTION", kind.isin("WIRE_IN", "WIRE_OUT") & F.col("counterparty_country").isin(monitoring.HIGH_RISK_COUNTRIES), listed),
        WindowRule(
            "DORMANT_REACTIVATION", F.lit(True), wake_span, lambda rows: monitoring.dormant_reactivation(rows, gap, wake_span, woken), quiet=True
        ),
        WindowRule(
            "ROUND_AMOUNTS", kind.isin(OUTGOING) & (cents >= round_minimum) & (cents % unit == 0), round_span,
            lambda rows: monitoring.round_amounts(rows, round_minimum, unit, round_count, round_span),
        ),
    ]


class Detector:
    """Detection run by run; the state of run n lies below `path`/run=n, so a run that is repeated replaces itself."""

    def __init__(self, spark: SparkSession, path: str, rules: list[WindowRule | TotalRule]):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def _load(self, run: int, rule: str, name: str, columns: str) -> DataFrame:
        """A part of the state before a run; empty before the first."""
        if run == 0:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(f"{self.path}/run={run - 1}/{rule}/{name}")

    def _store(self, run: int, rule: str, name: str, columns: str, rows: DataFrame) -> None:
        rows.select(*_names(columns)).write.mode("overwrite").parquet(f"{self.path}/run={run}/{rule}/{name}")

    def advance(self, run: int, new: dict[str, DataFrame]) -> None:
        """Run number `run`, counted from 0 without gaps, over the new transactions of each rule."""
        for rule in self.rules:
            rows = new[rule.rule_id].select(*_names(TXN)).where(rule.relevant)
            (self._window if isinstance(rule, WindowRule) else self._total)(run, rule, rows)

    def hits(self, run: int) -> dict[str, RuleHits]:
        """Summaries up to a run, and the evidence that the run itself added, for `monitoring.score_alerts`."""
        return {
            r.rule_id: RuleHits(self._load(run + 1, r.rule_id, "summary", SUMMARY), self._load(run + 1, r.rule_id, "given", GIVEN).select(*EVIDENCE))
            for r in self.rules
        }

    def _window(self, run: int, rule: WindowRule, new: DataFrame) -> None:
        kept = self._load(run, rule.rule_id, "kept", KEPT)
        marks = self._load(run, rule.rule_id, "marks", MARKS)
        rows = staged(kept.unionByName(new.withColumn("given", F.lit(False))), "detect-rows")
        seen = rows.select(*_names(TXN))
        if rule.quiet:
            # the last row before the kept ones tells how long the silence was; it carries no amount and is no evidence
            silent = marks.select("customer_id", "ts", *(F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(TXN) if f.name not in ("customer_id", "ts")))
            seen = seen.unionByName(silent.withColumn("amount_cents", F.lit(0).cast("long")))
        evidence = rule.run(seen).evidence.where("txn_id IS NOT NULL").select("customer_id", "txn_id").distinct()
        flagged = staged(rows.join(evidence.withColumn("hit", F.lit(True)), ["customer_id", "txn_id"], "left"), "detect-flagged")
        given = flagged.where("hit AND NOT given").withColumn("incoming", F.col("type") == "WIRE_IN")
        self._given(run, rule.rule_id, given)

        newest = rows.agg(F.max("ts").alias("ts")).scalar()
        open_since = newest - F.expr(f"INTERVAL {rule.reach}")
        state = flagged.withColumn("given", F.col("given") | F.coalesce("hit", F.lit(False)))
        self._store(run, rule.rule_id, "kept", KEPT, state.where(F.col("ts") >= open_since))
        closed = state.where(F.col("ts") < open_since).select("customer_id", "ts")
        self._store(run, rule.rule_id, "marks", MARKS, marks.unionByName(closed).groupBy("customer_id").agg(F.max("ts").alias("ts")))

    def _total(self, run: int, rule: TotalRule, new: DataFrame) -> None:
        waiting = self._load(run, rule.rule_id, "kept", KEPT)
        before = self._load(run, rule.rule_id, "totals", TOTALS)
        more = new.groupBy("customer_id").agg(F.sum("amount_cents").alias("total_cents"))
        totals = staged(before.unionByName(more).groupBy("customer_id").agg(F.sum("total_cents").alias("total_cents")), "detect-totals")
        over = totals.where(F.col("total_cents") >= rule.minimum).select("customer_id")
        rows = waiting.unionByName(new.withColumn("given", F.lit(False)))
        self._given(run, rule.rule_id, rows.join(over, "customer_id", "left_semi").withColumn("incoming", F.lit(True)))
        self._store(run, rule.rule_id, "kept", KEPT, rows.join(over, "customer_id", "left_anti"))
        self._store(run, rule.rule_id, "totals", TOTALS, totals)

    def _given(self, run: int, rule: str, given: DataFrame) -> None:
        """Store a run's new evidence and add it to the summaries. Evidence is given once, so sums only grow."""
        self._store(run, rule, "given", GIVEN, given)
        found = self._load(run + 1, rule, "given", GIVEN)
        incoming = F.col("incoming")
        whole = rule != "RAPID_MOVEMENT"
        # of rapid movement the wires count as the total and begin the alert; what went out ends it
        counts, ends = (F.lit(True), F.lit(True)) if whole else (incoming, ~incoming)
        more = found.select(
            "customer_id", F.when(counts, F.col("amount_cents")).alias("total_cents"), F.when(counts, F.col("ts")).alias("first_ts"),
            F.when(ends, F.col("ts")).alias("last_ts"), F.lit(1).cast("long").alias("n_evidence"),
        )
        parts = self._load(run, rule, "summary", SUMMARY), more.select(*_names(SUMMARY))
        merged = reduce(DataFrame.unionByName, parts).groupBy("customer_id").agg(
            F.sum("total_cents").alias("total_cents"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_evidence").alias("n_evidence")
        )
        self._store(run, rule, "summary", SUMMARY, merged)
