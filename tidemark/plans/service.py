"""City service requests: equity against request mix, operations figures, backlog.

`now` is the instant that decides whether an open request is overdue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.aggregates import event_series, median, mix_adjusted
from ..operators.filters import censored_on_time, optional
from ..operators.hotkeys import join_dimension


def with_target(requests: DataFrame, categories: DataFrame, now: Column) -> DataFrame:
    """Requests with their category's target, `on_time` (NULL while undecided) and `overdue`."""
    target = categories.select("category", F.col("department").alias("target_department"), "sla_days")
    joined = join_dimension(requests, target, ["category"])
    due = F.timestamp_add("DAY", F.col("sla_days"), F.col("created_at"))
    return joined.withColumns(
        {
            "on_time": censored_on_time(F.col("created_at"), F.col("closed_at"), F.col("sla_days"), now),
            "overdue": now > due,
        }
    )


def service_equity(
    requests: DataFrame, categories: DataFrame, districts: DataFrame, now: Column, department: str = "All", threshold: float = 5.0
) -> DataFrame:
    """Districts' on-time rate beside the rate their mix of categories would give citywide.

    Districts without any closed request are left out. Flagged when the gap is at or below
    -threshold points.
    """
    chosen = optional(categories, "department", department)
    rows = with_target(requests, chosen, now)
    adjusted = mix_adjusted(rows, "district_id", "category", "on_time")
    days = (F.unix_timestamp(F.col("closed_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 86400
    raw = rows.where(F.col("closed_at").isNotNull()).groupBy("district_id").agg(median(days).alias("median_days"))
    gap = F.lit(100) * (F.col("actual") - F.col("expected"))
    return (
        adjusted.join(raw, "district_id")
        .join(districts.select("district_id", F.col("name").alias("district"), "population"), "district_id")
        .select(
            "district_id",
            "district",
            "population",
            "decided",
            F.round(F.lit(100) * F.col("actual"), 1).alias("on_time_pct"),
            F.round(F.lit(100) * F.col("expected"), 1).alias("expected_pct"),
            F.round(gap, 1).alias("gap_pts"),
            F.round("median_days", 1).alias("raw_median_days"),
            (gap <= -F.lit(threshold)).alias("flagged"),
        )
    )


def _pct_on_time(column: Column) -> Column:
    return F.round(F.lit(100) * F.avg(column.cast("int")), 1)


def operations_kpis(requests: DataFrame, categories: DataFrame, now: Column) -> DataFrame:
    """One row: open, opened in 7 days, open and overdue, on time over 30 days."""
    is_open = F.col("status") == "OPEN"
    month = F.col("created_at") >= now - F.expr("INTERVAL 30 DAYS")
    return with_target(requests, categories, now).agg(
        F.count_if(is_open).alias("open_requests"),
        F.count_if(F.col("created_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("opened_7d"),
        F.count_if(is_open & F.col("overdue")).alias("overdue"),
        _pct_on_time(F.when(month, F.col("on_time"))).alias("on_time_30d"),
    )


def weekly_flow(requests: DataFrame) -> DataFrame:
    """Requests opened and closed per week (weeks start on Monday)."""
    return event_series(requests, {"opened": F.col("created_at"), "closed": F.col("closed_at")}, "week")


def on_time_by_department(requests: DataFrame, categories: DataFrame, now: Column) -> DataFrame:
    """On-time percentage of decided requests per department."""
    rows = with_target(requests, categories, now)
    return rows.groupBy(F.col("target_department").alias("department")).agg(_pct_on_time(F.col("on_time")).alias("on_time_pct"))


def backlog(requests: DataFrame, categories: DataFrame, now: Column) -> DataFrame:
    """Open requests per category with its target, and how many are overdue."""
    waiting = with_target(requests.where(F.col("status") == "OPEN"), categories, now)
    return waiting.groupBy("category", F.col("target_department").alias("department"), F.col("sla_days").alias("target_days")).agg(
        F.count(F.lit(1)).alias("open"), F.count_if("overdue").alias("overdue")
    )


def open_points(requests: DataFrame, categories: DataFrame, now: Column, overdue_only: bool = False) -> DataFrame:
    """Coordinates of open requests."""
    waiting = with_target(requests.where(F.col("status") == "OPEN"), categories, now)
    return (waiting.where("overdue") if overdue_only else waiting).select("lat", "lon")


def lookup(requests: DataFrame, categories: DataFrame, request_id: str) -> DataFrame:
    """One request with its target."""
    wanted = requests.where(F.col("request_id") == request_id.strip().upper())
    return wanted.join(categories.select("category", "sla_days"), "category")


def update_facts(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """Facts for a resident update. The free-text description is left out on purpose."""
    rows = join_dimension(requests, categories.select("category", "sla_days"), ["category"])
    day = "MMMM dd, yyyy"
    outcome = F.when(
        F.col("status") == "CLOSED", F.concat(F.lit("Resolved on "), F.date_format("closed_at", day), F.lit("."))
    ).otherwise("Status: open, assigned to the department's work queue.")
    facts = F.concat_ws(
        "\n",
        F.format_string("Request %s: %s (%s department).", "request_id", "category", "department"),
        F.format_string("Reported %s. Target time to resolve: %d days.", F.date_format("created_at", day), F.col("sla_days")),
        outcome,
    )
    return rows.select("request_id", strip(facts).alias("facts"))
