"""Small policy columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def service_credit(plan: Column, monthly: Column, kind: Column, minutes: Column) -> Column:
    """A day's charge per started four hours of an outage of an hour or more, doubled for business
    plans and capped at half the monthly charge; nothing otherwise."""
    days = F.ceil(minutes / 240)
    owed = monthly / 30 * days * F.when(plan == "BUSINESS", 2).otherwise(1)
    earned = (kind == "OUTAGE") & (minutes >= 60)
    return F.when(earned, F.bround(F.least(owed, monthly / 2), 2)).otherwise(F.lit(0.0))


def churn_risk(incidents: Column, opened_ticket: Column) -> Column:
    """HIGH after two incidents or a ticket about this one."""
    return F.when((incidents >= 2) | opened_ticket, "HIGH").otherwise("NORMAL")


def work_priority(status: Column) -> Column:
    """Work-order priority of a machine status."""
    return F.when(status == "ALERT", "HIGH").when(status == "WATCH", "MEDIUM").otherwise("LOW")


def model_permission(credentialed: Column, operator_vetted: bool = False) -> Column:
    """May rows of this dataset be sent to a model? Credentialed data needs a vetted endpoint."""
    return F.when(~credentialed, F.lit(True)).otherwise(F.lit(operator_vetted))
