"""Network incidents from interval KPIs, customer impact, credits and outreach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import churn_risk, service_credit
from ..operators.hotkeys import HOT_ROWS, Hot
from ..operators.joins import interval_join
from ..operators.text import fallback_message, render
from ..operators.windows import islands
from ..streaming.ordered import islands_stream, open_islands

INTERVAL_MINUTES = 15


def incidents(
    kpis: DataFrame, sites: DataFrame, min_rows: int = 2, interval_minutes: int = INTERVAL_MINUTES,
    low_availability: float = 95, high_drops: float = 2, outage_below: float = 50,
    max_gap: str | None = None, hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Runs of at least `min_rows` bad intervals per site, as outages or degradations.

    Ongoing when the run touches the newest instant of the whole table.
    """
    bad = _bad(low_availability, high_drops)
    aggs = [
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("intervals"),
        F.min("availability_pct").alias("lowest"),
        F.max("drop_call_rate_pct").alias("worst_drops"),
    ]
    runs = islands(kpis, ["site_id"], ["ts"], bad, aggs, min_rows, max_gap, hot)
    newest = kpis.agg(F.max("ts").alias("ts")).scalar()
    return describe_incidents(runs, sites, newest, interval_minutes, outage_below)


def _bad(low_availability: float, high_drops: float) -> Column:
    return (F.col("availability_pct") < low_availability) | (F.col("drop_call_rate_pct") > high_drops)


def describe_incidents(
    runs: DataFrame, sites: DataFrame, newest: Column, interval_minutes: int = INTERVAL_MINUTES, outage_below: float = 50
) -> DataFrame:
    """Runs of bad intervals (site_id, started_at, last_ts, intervals, lowest, worst_drops) as incidents."""
    site = F.col("site_id").cast("string")
    return runs.join(sites.select("site_id", "area"), "site_id").select(
        F.concat(site, F.lit("-"), F.date_format("started_at", "yyyyMMddHHmm")).alias("incident_id"),
        "site_id",
        "area",
        F.when(F.col("lowest") < outage_below, "OUTAGE").otherwise("DEGRADATION").alias("kind"),
        "started_at",
        (F.col("last_ts") + F.expr(f"INTERVAL {int(interval_minutes)} MINUTES")).alias("ended_at"),
        (F.col("intervals") * interval_minutes).alias("duration_min"),
        (F.col("last_ts") == newest).alias("ongoing"),
        F.round("lowest", 1).alias("min_availability_pct"),
        F.round("worst_drops", 2).alias("max_drop_call_pct"),
    )


def bad_runs_stream(
    kpis: DataFrame, lateness: str, min_rows: int = 2, low_availability: float = 95, high_drops: float = 2, max_gap: str | None = None
) -> DataFrame:
    """Streaming form of the runs behind `incidents`: closed runs of bad intervals per site, for `describe_incidents`.

    Intervals may come in any order within `lateness`; a row without a site only moves the clock on.
    """
    measures = {"lowest": ("min", F.col("availability_pct")), "worst_drops": ("max", F.col("drop_call_rate_pct"))}
    runs = islands_stream(kpis, ["site_id"], "ts", _bad(low_availability, high_drops), measures, lateness, min_rows=min_rows, max_gap=max_gap)
    return runs.withColumnRenamed("rows", "intervals")


def bad_runs_open(spark: SparkSession, checkpoint: str, min_rows: int = 2) -> DataFrame:
    """Runs that a stopped `bad_runs_stream` has not closed yet."""
    return open_islands(spark, checkpoint, ["lowest", "worst_drops"], min_rows).withColumnRenamed("rows", "intervals")


def incident_impact(found: DataFrame, customers: DataFrame, tickets: DataFrame, incident_ids: list[str] | None = None) -> DataFrame:
    """Affected customers per incident (all incidents, or the given ones).

    A customer is affected when homed on the incident's site. `incidents_in_period` counts all
    incidents at that site; `opened_ticket` looks from the start to 24 hours after the end.
    """
    period = found.groupBy("site_id").agg(F.count(F.lit(1)).alias("incidents_in_period"))
    chosen = found.where(F.col("incident_id").isin(incident_ids)) if incident_ids else found
    spans = chosen.join(period, "site_id").select(
        "incident_id", F.col("site_id").alias("home_site_id"), "kind", "duration_min", "started_at",
        (F.col("ended_at") + F.expr("INTERVAL 24 HOURS")).alias("watch_until"), "incidents_in_period",
    )
    # Tickets first meet the incidents of their customer's home site; only customers who called remain.
    homes = customers.select("customer_id", "home_site_id")
    calls = tickets.select("customer_id", "opened_at").join(homes, "customer_id")
    marks = spans.select("home_site_id", "incident_id", "started_at", "watch_until")
    called = (
        interval_join(calls, marks, ["home_site_id"], "opened_at", "started_at", "watch_until", 86_400)
        .select("incident_id", "customer_id")
        .distinct()
        .withColumn("opened_ticket", F.lit(True))
    )
    people = customers.select("customer_id", "first_name", "plan", "monthly_charge", "tenure_months", "home_site_id")
    rows = people.join(spans, "home_site_id").join(called, ["incident_id", "customer_id"], "left")
    return rows.select(
        "incident_id", "kind", "duration_min", "customer_id", "first_name", "plan", "monthly_charge", "tenure_months",
        "incidents_in_period", F.coalesce("opened_ticket", F.lit(False)).alias("opened_ticket"),
    )


def with_policy(impact: DataFrame) -> DataFrame:
    """Impact rows with the service credit and churn risk."""
    return impact.withColumns(
        {
            "credit": service_credit(F.col("plan"), F.col("monthly_charge"), F.col("kind"), F.col("duration_min")),
            "churn_risk": churn_risk(F.col("incidents_in_period"), F.col("opened_ticket")),
        }
    )


def impact_totals(policy: DataFrame) -> DataFrame:
    """Per incident: customers, high risk, tickets, credits."""
    return policy.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("churn_risk") == "HIGH").alias("high_risk"),
        F.count_if("opened_ticket").alias("tickets"),
        F.round(F.sum("credit"), 2).alias("credits"),
    )


def outreach_audience(policy: DataFrame, outreach: DataFrame, high_risk_only: bool = True) -> DataFrame:
    """Customers to contact who are not yet queued for the incident."""
    rows = policy.where(F.col("churn_risk") == "HIGH") if high_risk_only else policy
    return rows.join(outreach.select("incident_id", "customer_id"), ["incident_id", "customer_id"], "left_anti")


def queue_messages(audience: DataFrame, found: DataFrame, approved_by: str, now: Column) -> DataFrame:
    """Outreach rows with the standard message, filled in per customer.

    The credit sentence appears for an incident when any of its audience has a credit.
    """
    owed = audience.groupBy("incident_id").agg((F.max("credit") > 0).alias("with_credit"))
    texts = found.join(owed, "incident_id").select(
        "incident_id",
        fallback_message(F.col("kind"), F.col("area"), F.col("started_at"), F.col("ongoing"), F.col("with_credit")).alias("text"),
    )
    return audience.join(texts, "incident_id").select(
        "incident_id",
        "customer_id",
        F.lit("SMS").alias("channel"),
        render(F.col("text"), F.col("credit")).alias("message"),
        "credit",
        F.lit(approved_by).alias("approved_by"),
        now.alias("queued_at"),
        F.lit("QUEUED").alias("status"),
    )


def outreach_summary(outreach: DataFrame) -> DataFrame:
    """Queued messages and credits per incident."""
    return outreach.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.round(F.sum("credit"), 2).alias("credits"),
        F.max("approved_by").alias("approved_by"),
        F.max("queued_at").alias("queued_at"),
    )


def recent_kpis(kpis: DataFrame, days: int = 3, site_id=None) -> DataFrame:
    """KPIs of the last days before the newest instant of the table."""
    newest = kpis.agg(F.max("ts").alias("ts")).scalar()
    rows = kpis if site_id is None else kpis.where(F.col("site_id") == site_id)
    return rows.where(F.col("ts") >= newest - F.expr(f"INTERVAL {int(days)} DAYS"))


def incident_brief(found: DataFrame, with_credit: Column) -> DataFrame:
    """One line of facts per incident for a message draft."""
    at = "HH:mm 'on' MMM dd"
    state = F.when(F.col("ongoing"), "ongoing, engineers are working on it").otherwise(
        F.concat(F.lit("resolved at "), F.date_format("ended_at", at))
    )
    what = F.when(F.col("kind") == "OUTAGE", "no service").otherwise("dropped calls and slow data")
    credit = F.when(with_credit, "yes, use {credit}").otherwise("no, do not mention credit")
    text = F.format_string(
        "Incident: %s in the %s area from %s, %s. Credit applies: %s.", what, F.col("area"), F.date_format("started_at", at), state, credit
    )
    return found.select("incident_id", text.alias("brief"))
