"""Subscription spend. Money is integer cents; annual costs count a twelfth per month, rounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import rank_of, violations
from ..operators.maintenance import partial_update, update_by_key

# What a subscription may hold.
BILLING_CYCLES = ["monthly", "annual", "one_time"]
CATEGORIES = ["Engineering", "Design", "Marketing", "Sales", "HR", "Security", "Finance", "Operations", "Other"]
STATUSES = ["active", "trial", "cancelled", "pending_cancellation"]
LIVE = ["active", "trial"]


def monthly_equivalent() -> Column:
    cost = F.col("cost_cents")
    twelfth = F.round(cost / F.lit(12.0)).cast("long")
    return F.when(F.col("billing_cycle") == "monthly", cost).when(F.col("billing_cycle") == "annual", twelfth).otherwise(0)


def annual_equivalent() -> Column:
    cost = F.col("cost_cents")
    return F.when(F.col("billing_cycle") == "annual", cost).when(F.col("billing_cycle") == "monthly", cost * 12).otherwise(0)


def spend_by_category(subscriptions: DataFrame) -> DataFrame:
    """Live subscriptions and monthly spend per category."""
    live = subscriptions.where(F.col("status").isin(LIVE))
    return live.groupBy("category").agg(
        F.count(F.lit(1)).alias("subscription_count"), F.coalesce(F.sum(monthly_equivalent()), F.lit(0)).alias("monthly_spend_cents")
    )


def spend_overview(subscriptions: DataFrame, today: Column) -> DataFrame:
    """One row: live and cancelled counts, monthly and annual spend, renewals in the next 30 days (both ends in)."""
    live = F.col("status").isin(LIVE)
    soon = F.col("renewal_date").between(today, F.date_add(today, 30))
    return subscriptions.agg(
        F.count_if(live).alias("active_count"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_count"),
        F.coalesce(F.sum(F.when(live, monthly_equivalent()).otherwise(0)), F.lit(0)).alias("monthly_spend_cents"),
        F.coalesce(F.sum(F.when(live, annual_equivalent()).otherwise(0)), F.lit(0)).alias("annual_spend_cents"),
        F.count_if(live & soon).alias("renewals_next_30d"),
    )


def listing_order() -> list[Column]:
    """Status rank, earliest renewal (none last), name, id."""
    return [
        rank_of(F.col("status"), ["active", "trial", "pending_cancellation"]),
        F.col("renewal_date").asc_nulls_last(),
        F.col("name"),
        F.col("id"),
    ]


def subscription_violations() -> Column:
    """Broken rules of a submitted subscription."""
    return violations(
        allowed={"category": CATEGORIES, "billing_cycle": BILLING_CYCLES, "status": STATUSES},
        minimum={"cost_cents": 0, "license_count": 1},
        required=["name", "vendor", "category", "cost_cents", "billing_cycle", "owner_name", "start_date"],
        emails=["owner_email"],
    )


def change_status(subscriptions: DataFrame, changes: DataFrame, today: Column, now: Column) -> DataFrame:
    """Apply new statuses; the cancellation date is set only by a cancellation."""
    cancelled = F.col("new.status") == "cancelled"
    sets = {
        "status": F.col("new.status"),
        "cancellation_date": F.when(cancelled, today).otherwise(F.col("cancellation_date")),
        "updated_at": now,
    }
    return update_by_key(subscriptions, changes, ["id"], sets)


def edit(subscriptions: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Patch the given columns; a NULL in the change leaves the old value."""
    return partial_update(subscriptions, changes, ["id"], columns)
