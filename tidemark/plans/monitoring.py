"""Transaction-monitoring rules, alert scoring, queue and programme metrics.

Transactions: txn_id, customer_id, ts, type, amount_cents (long), counterparty_country. Amounts are
integer cents, so every sum and threshold is exact.

Each rule gives a `RuleHits`: a summary per customer, and the evidence as one row per transaction.
No rule compares transactions pairwise; windows are running sums and next- or last-mark scans, which
stay parallel when one customer owns much of the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import share_pct, union_all
from ..operators.context import assemble_pages
from ..operators.filters import right_closed_bands
from ..operators.hotkeys import HOT_ROWS, Hot, hot_keys, join_dimension
from ..operators.joins import interval_totals, nearest_mark
from ..operators.windows import paged_lists, previous, threads, trailing_span
from ..operators.workflow import TERMINAL

# The rules, and the countries of the jurisdiction rule.
HIGH_RISK_COUNTRIES = ["IR", "KP", "MM", "SY", "YE"]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    version: int
    severity: int
    description: str


RULES = {
    r.rule_id: r
    for r in [
        Rule("STRUCTURING", 1, 70, "3+ cash deposits of $8,000-$9,999.99 within 7 days (just under the $10,000 CTR threshold)."),
        Rule("RAPID_MOVEMENT", 1, 85, "Incoming wire of $20,000+ with 80%+ of it sent out again within 48 hours."),
        Rule("HIGH_RISK_JURISDICTION", 1, 60, "$10,000+ in total wires to or from high-risk jurisdictions (IR, KP, MM, SY, YE)."),
        Rule("DORMANT_REACTIVATION", 1, 65, "No activity for 60+ days, then $25,000+ moved within 7 days."),
        Rule("ROUND_AMOUNTS", 1, 40, "5+ outgoing transfers of exact round thousands ($5,000+) within 30 days."),
    ]
}

CUSTOMER = ["customer_id"]
EVIDENCE = ["customer_id", "txn_id", "ts", "amount_cents"]
OUTGOING = ["WIRE_OUT", "ACH_OUT"]


class RuleHits(NamedTuple):
    summary: DataFrame  # customer_id, total_cents, first_ts, last_ts, n_evidence
    evidence: DataFrame  # customer_id, txn_id, ts, amount_cents


def _summarise(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("customer_id").agg(
        F.sum("amount_cents").alias("total_cents"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_evidence"),
    )


def burst(rows: DataFrame, min_count: int, span: str, hot: Hot = HOT_ROWS) -> RuleHits:
    """At least `min_count` rows within `span`; evidence is every row inside some such window.

    A row is inside one exactly when the next triggering instant is at most `span` away.
    """
    known = hot_keys(rows, CUSTOMER, hot)
    counts = trailing_span(rows, CUSTOMER, "ts", span, {"n": F.lit(1)}, known)
    triggers = counts.where(F.col("n") >= min_count).select("customer_id", "ts")
    near = nearest_mark(rows.select(*EVIDENCE), triggers, CUSTOMER, "ts", "trigger_ts", forward=True, hot=known)
    evidence = near.where(F.col("trigger_ts") <= F.col("ts") + F.expr(f"INTERVAL {span}")).select(*EVIDENCE)
    return RuleHits(_summarise(evidence), evidence)


def structuring(
    txns: DataFrame, low: int = 800_000, high: int = 999_999, min_count: int = 3, span: str = "7 days",
    hot: Hot = HOT_ROWS,
) -> RuleHits:
    """Repeated cash deposits just below the reporting threshold."""
    deposits = txns.where((F.col("type") == "CASH_DEPOSIT") & F.col("amount_cents").between(low, high))
    return burst(deposits, min_count, span, hot)


def round_amounts(
    txns: DataFrame, minimum: int = 500_000, unit: int = 100_000, min_count: int = 5, span: str = "30 days",
    hot: Hot = HOT_ROWS,
) -> RuleHits:
    """Repeated outgoing transfers of exact round amounts."""
    cents = F.col("amount_cents")
    rounded = txns.where(F.col("type").isin(OUTGOING) & (cents >= minimum) & (cents % unit == 0))
    return burst(rounded, min_count, span, hot)


def rapid_movement(
    txns: DataFrame, minimum: int = 2_000_000, share_pct: int = 80, span: str = "48 hours",
    hot: Hot = HOT_ROWS,
) -> RuleHits:
    """Large incoming wires mostly sent out again soon after (later than the wire itself)."""
    window = F.expr(f"INTERVAL {span}")
    wires = txns.where((F.col("type") == "WIRE_IN") & (F.col("amount_cents") >= minimum))
    wires = wires.select("customer_id", "txn_id", "ts", "amount_cents")
    out = txns.where(F.col("type").isin(OUTGOING)).select(*EVIDENCE)
    known = hot_keys(txns.where(F.col("type").isin("WIRE_IN", *OUTGOING)), CUSTOMER, hot)
    sent = interval_totals(
        wires, out, CUSTOMER, "ts", ["txn_id", "amount_cents"], F.col("ts"), F.col("ts") + window,
        {"sent_cents": F.col("amount_cents")}, hot=known,
    )
    moved = sent.where(
        (F.col("sent_cents") > 0) & (F.col("sent_cents") * 100 >= F.col("amount_cents") * share_pct)
    ).select("customer_id", "txn_id")
    hits = wires.join(moved, ["customer_id", "txn_id"], "left_semi")
    after = nearest_mark(
        out, hits.select("customer_id", "ts"), CUSTOMER, "ts", "wire_ts", forward=False, strict=True, hot=known
    )
    followed = after.where(F.col("ts") <= F.col("wire_ts") + window).select(*EVIDENCE)
    evidence = hits.select(*EVIDENCE, F.lit(True).alias("incoming")).unionByName(
        followed.withColumn("incoming", F.lit(False))
    )
    incoming = F.col("incoming")
    summary = evidence.groupBy("customer_id").agg(
        F.sum(F.when(incoming, F.col("amount_cents"))).alias("total_cents"),
        F.min(F.when(incoming, F.col("ts"))).alias("first_ts"),
        F.max(F.when(~incoming, F.col("ts"))).alias("last_ts"),
        F.count(F.lit(1)).alias("n_evidence"),
    )
    return RuleHits(summary, evidence.select(*EVIDENCE))


def high_risk_jurisdiction(txns: DataFrame, countries: list[str] = HIGH_RISK_COUNTRIES, minimum: int = 1_000_000) -> RuleHits:
    """Wires to or from listed countries that add up to the minimum."""
    wires = txns.where(F.col("type").isin("WIRE_IN", "WIRE_OUT") & F.col("counterparty_country").isin(countries))
    wires = wires.select(*EVIDENCE)
    summary = _summarise(wires).where(F.col("total_cents") >= minimum)
    return RuleHits(summary, wires.join(summary.select("customer_id"), "customer_id", "left_semi"))


def dormant_reactivation(
    txns: DataFrame, gap: str = "60 days", span: str = "7 days", minimum: int = 2_500_000,
    hot: Hot = HOT_ROWS,
) -> RuleHits:
    """A long silence, then a large sum within the following span (both ends included).

    The gap must be longer than the span: bursts of one customer then never overlap.
    """
    rows = txns.select(*EVIDENCE)
    known = hot_keys(rows, CUSTOMER, hot)
    window = F.expr(f"INTERVAL {span}")
    instants = rows.groupBy("customer_id", "ts").agg(F.sum("amount_cents").alias("amount_cents"))
    woken = previous(instants, CUSTOMER, ["ts"], "ts", "prev_ts", known).where(
        F.col("ts") >= F.col("prev_ts") + F.expr(f"INTERVAL {gap}")
    ).select("customer_id", "ts")
    moved = interval_totals(
        woken.withColumn("wake_ts", F.col("ts")), rows, CUSTOMER, "ts", ["wake_ts"], F.col("ts"), F.col("ts") + window,
        {"total_cents": F.col("amount_cents")}, include_lo=True, hot=known,
    )
    bursts = moved.where(F.col("total_cents") >= minimum).select("customer_id", F.col("wake_ts").alias("ts"))
    near = nearest_mark(rows, bursts, CUSTOMER, "ts", "wake_ts", forward=False, hot=known)
    inside = near.where(F.col("ts") <= F.col("wake_ts") + window)
    return RuleHits(_summarise(inside), inside.select(*EVIDENCE))


def run_rules(txns: DataFrame, hot: Hot = HOT_ROWS) -> dict[str, RuleHits]:
    """All rules with their default thresholds; hot customers are looked up once for all."""
    hot = hot_keys(txns, CUSTOMER, hot)
    return {
        "STRUCTURING": structuring(txns, hot=hot),
        "RAPID_MOVEMENT": rapid_movement(txns, hot=hot),
        "HIGH_RISK_JURISDICTION": high_risk_jurisdiction(txns),
        "DORMANT_REACTIVATION": dormant_reactivation(txns, hot=hot),
        "ROUND_AMOUNTS": round_amounts(txns, hot=hot),
    }


def _alert_id() -> Column:
    return F.concat(F.lit("AL-"), F.col("rule_id"), F.lit("-"), F.col("customer_id")).alias("alert_id")


def score_alerts(hits: dict[str, RuleHits], customers: DataFrame) -> DataFrame:
    """One alert per customer and rule, scored by customer risk. Ids are stable across reruns."""
    found = union_all(
        [
            h.summary.select(
                F.lit(r).alias("rule_id"), F.lit(RULES[r].version).alias("rule_version"), F.lit(RULES[r].severity).alias("severity"), "*"
            )
            for r, h in hits.items()
        ]
    )
    rating = F.when(F.col("risk_rating") == "HIGH", 1.4).when(F.col("risk_rating") == "MEDIUM", 1.15).otherwise(1.0)
    exposed = F.when(F.col("pep"), 1.3).otherwise(1.0)
    # Decimal factors: the product has no binary rounding at the .5 edge.
    score = F.round(F.col("severity") * rating.cast("decimal(3,2)") * exposed.cast("decimal(3,2)"))
    return found.join(customers.select("customer_id", "risk_rating", "pep"), "customer_id").select(
        _alert_id(),
        "rule_id",
        "rule_version",
        "customer_id",
        F.least(F.lit(100), score.cast("int")).alias("score"),
        "n_evidence",
        (F.col("total_cents") / 100).alias("total_amount"),
        "first_ts",
        "last_ts",
        F.col("last_ts").alias("created_at"),
    )


def alert_evidence(hits: dict[str, RuleHits]) -> DataFrame:
    """Evidence of all alerts, one row per alert and transaction."""
    rows = union_all([h.evidence.select(F.lit(r).alias("rule_id"), "*") for r, h in hits.items()])
    return rows.select(_alert_id(), "rule_id", *EVIDENCE)


def evidence_lists(evidence: DataFrame, page_size: int = 10_000) -> DataFrame:
    """Transaction ids per alert as arrays; an alert with very many continues on further pages."""
    return paged_lists(evidence, ["alert_id"], "txn_id", "evidence_txn_ids", page_size)


def rules_catalog(spark: SparkSession) -> DataFrame:
    """The rule definitions as a table."""
    return spark.createDataFrame(
        [(r.rule_id, r.version, r.severity, r.description) for r in RULES.values()],
        "rule_id string, version int, severity int, description string",
    )


def alert_status(alerts: DataFrame, customers: DataFrame, dispositions: DataFrame, as_of: Column) -> DataFrame:
    """Alerts with their latest decided status, OPEN without a decision, and age in days."""
    latest = dispositions.groupBy("alert_id").agg(F.max_by("new_status", F.struct("decided_at", "new_status")).alias("status"))
    named = alerts.join(customers.select("customer_id", "name", "risk_rating"), "customer_id")
    return named.join(latest, "alert_id", "left").withColumns(
        {"status": F.coalesce("status", F.lit("OPEN")), "age_days": F.datediff(as_of, F.to_date("created_at"))}
    )


def alert_queue(status: DataFrame, statuses: list[str], rules: list[str] | None = None) -> DataFrame:
    """The alerts in the chosen states, highest score first, then oldest."""
    rows = status.where(F.col("status").isin(statuses))
    if rules:
        rows = rows.where(F.col("rule_id").isin(rules))
    return rows.orderBy(F.col("score").desc(), F.col("age_days").desc(), "alert_id")


def rule_performance(status: DataFrame, truth: DataFrame) -> DataFrame:
    """Per rule: alerts, decided, approved, false positives, approval rate of decided, planted hits."""
    known = truth.select("customer_id", F.col("typology").alias("rule_id"), F.lit(True).alias("planted")).distinct()
    state = F.col("status")
    decided, approved = F.count_if(state.isin(TERMINAL)), F.count_if(state == "SAR_APPROVED")
    rows = F.count(F.lit(1))
    return (
        status.join(known, ["customer_id", "rule_id"], "left")
        .groupBy("rule_id")
        .agg(
            rows.alias("alerts"),
            decided.alias("decided"),
            approved.alias("sar_approved"),
            F.count_if(state == "CLOSED_FALSE_POSITIVE").alias("false_positives"),
            share_pct(approved, decided).alias("sar_rate_pct"),
            share_pct(F.count_if(F.col("planted")), rows).alias("planted_hit_pct"),
        )
    )


def programme_counts(status: DataFrame, sla_days: int) -> DataFrame:
    """One row: open, awaiting review, overdue, approved."""
    state = F.col("status")
    return status.agg(
        F.count_if(state.isin("OPEN", "RETURNED")).alias("open_alerts"),
        F.count_if(state == "ESCALATED").alias("awaiting_review"),
        F.count_if(~state.isin(TERMINAL) & (F.col("age_days") > sla_days)).alias("overdue"),
        F.count_if(state == "SAR_APPROVED").alias("sars_approved"),
    )


def age_bands(status: DataFrame, sla_days: int) -> DataFrame:
    """Undecided alerts per age band, bands closed on the right."""
    labels = ["0-7", "8-14", f"15-{sla_days}", f">{sla_days}"]
    band = right_closed_bands(F.col("age_days"), [-1, 7, 14, sla_days, float("inf")], labels)
    undecided = status.where(~F.col("status").isin(TERMINAL))
    return undecided.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("alerts"))


def draft_use(dispositions: DataFrame) -> DataFrame:
    """One row: escalations, and those that used a draft."""
    escalated = dispositions.where(F.col("action") == "ESCALATE")
    return escalated.agg(F.count(F.lit(1)).alias("escalations"), F.count_if(F.col("ai_draft_used")).alias("with_ai_draft"))


def activity_profile(txns: DataFrame, keys: list[str]) -> DataFrame:
    """Count and total per transaction type."""
    return txns.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"), (F.sum("amount_cents") / 100).alias("total"))


def _usd(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def alert_context(
    status: DataFrame, customers: DataFrame, evidence: DataFrame, txns: DataFrame, hot: Hot = HOT_ROWS, page_rows: int = 10_000
) -> DataFrame:
    """Investigation text per alert: rule, customer, flagged transactions, activity by type, other alerts.

    `status` comes from `alert_status`; customers have name, segment, occupation, risk_rating, pep and
    onboarded; transactions have a counterparty. Evidence beyond `page_rows` lines continues on
    further pages.
    """
    key = ["alert_id"]
    rules = [(r.rule_id, r.description) for r in RULES.values()]
    described = status.sparkSession.createDataFrame(rules, "rule_id string, description string")
    people = customers.select("customer_id", "segment", "occupation", "pep", "onboarded")
    parents = join_dimension(status.drop("segment", "occupation", "pep", "onboarded"), described, ["rule_id"]).join(people, "customer_id")
    heads = [
        F.concat(F.lit("## Alert "), F.col("alert_id")),
        F.format_string("Rule %s v%d: %s", "rule_id", "rule_version", "description"),
        F.format_string(
            "Risk score %d; flagged amount %s; activity %s to %s.",
            F.col("score"), _usd(F.col("total_amount")), F.col("first_ts").cast("string"), F.col("last_ts").cast("string"),
        ),
        F.lit("## Customer"),
        F.format_string(
            "%s (ID %d), %s, occupation %s, KYC risk %s%s, customer since %s.",
            F.col("name"), F.col("customer_id"), F.col("segment"), F.col("occupation"), F.col("risk_rating"),
            F.when(F.col("pep"), ", politically exposed person").otherwise(""), F.col("onboarded").cast("string"),
        ),
    ]
    # Evidence already carries customer, time and amount; only the flagged transactions' details join.
    details = txns.select("customer_id", "txn_id", "type", "counterparty", "counterparty_country")
    flagged = evidence.join(status.select(*key), key, "left_semi").join(details, ["customer_id", "txn_id"])
    transaction = F.format_string(
        "%s %s %s %s %s (%s)",
        F.col("txn_id").cast("string"), F.col("ts").cast("string"), F.col("type"), _usd(F.col("amount_cents") / 100),
        F.coalesce(F.col("counterparty").cast("string"), F.lit("")), F.col("counterparty_country"),
    )
    owners = status.select("alert_id", "customer_id")
    known = txns.join(status.select("customer_id").distinct(), "customer_id", "left_semi")
    # A customer has one row per transaction type and at most one alert per rule, so these stay small.
    profile = owners.join(activity_profile(known, CUSTOMER), "customer_id").withColumn("rank", -F.col("total"))
    activity = F.format_string("%s: %d, %s", F.col("type"), F.col("n"), _usd(F.col("total")))
    others = status.select("customer_id", F.col("alert_id").alias("other_id"), "rule_id", "status")
    prior = owners.join(others, "customer_id").where(F.col("alert_id") != F.col("other_id")).withColumn("rank", F.lit(0))
    earlier = F.format_string("%s (%s): %s", "other_id", "rule_id", "status")
    parts = [
        ("## Flagged transactions", "", threads(flagged, key, ["ts", "txn_id"], transaction, "text", page_rows=page_rows, hot=hot)),
        ("## Activity by type (count, total)", "", threads(profile, key, ["rank", "type"], activity, "text", hot=None)),
        ("## Prior alerts for this customer", "none", threads(prior, key, ["rank", "other_id"], earlier, "text", hot=None)),
    ]
    return assemble_pages(parents, heads, parts, key)
