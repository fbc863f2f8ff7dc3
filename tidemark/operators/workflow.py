"""Checks of an append-only decision log against a workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hotkeys import HOT_ROWS, Hot
from .scan import last, running
from .text import first_problem

# Status -> action -> new status.
_ANALYST = {
    "ESCALATE": "ESCALATED",
    "CLOSE_FALSE_POSITIVE": "CLOSED_FALSE_POSITIVE",
    "CLOSE_EXPLAINED": "CLOSED_EXPLAINED",
}
TRANSITIONS = {
    "OPEN": _ANALYST,
    "ESCALATED": {"APPROVE_SAR": "SAR_APPROVED", "RETURN": "RETURNED"},
    "RETURNED": _ANALYST,
}
REVIEW_ACTIONS = ["APPROVE_SAR", "RETURN"]
TERMINAL = ["SAR_APPROVED", "CLOSED_FALSE_POSITIVE", "CLOSED_EXPLAINED"]
MIN_RATIONALE = 20

# The problem texts.
NOT_ALLOWED = "Can't %s an alert that is %s."
SECOND_PERSON = "Maker-checker: a different person must review this escalation."
SHORT_RATIONALE = f"Rationale must be at least {MIN_RATIONALE} characters."
NO_ACTOR = "Unknown user: can't record a decision without an identity."


def next_status(status: Column, action: Column, transitions: dict = TRANSITIONS) -> Column:
    """Status an action leads to; NULL when it is not allowed."""
    steps = [(s, a, n) for s, actions in transitions.items() for a, n in actions.items()]
    out = F.when((status == steps[0][0]) & (action == steps[0][1]), steps[0][2])
    for s, a, n in steps[1:]:
        out = out.when((status == s) & (action == a), n)
    return out


def with_history(log: DataFrame, key: str, order: list[str], hot: Hot = HOT_ROWS) -> DataFrame:
    """Add the status before each decision and who last escalated before it."""
    escalator = F.when(F.col("action") == "ESCALATE", F.col("actor"))
    scans = {
        "status_before": last(F.col("new_status"), strict=True),
        "escalated_by": last(escalator, strict=True),
    }
    out = running(log, [key], order, scans, hot=hot)
    return out.withColumn("status_before", F.coalesce("status_before", F.lit("OPEN")))


def replay_workflow(log: DataFrame, key: str, order: list[str], transitions: dict = TRANSITIONS, hot: Hot = HOT_ROWS) -> DataFrame:
    """Each decision with the status it met, the status it should give, and its first problem if any."""
    seen = with_history(log, key, order, hot)
    expected = next_status(F.col("status_before"), F.col("action"), transitions)
    reviewing = F.col("action").isin(REVIEW_ACTIONS)
    own = F.coalesce(F.col("escalated_by") == F.col("actor"), F.lit(False))
    rationale = F.length(F.regexp_replace(F.coalesce("rationale", F.lit("")), r"^\s+|\s+$", ""))
    problem = first_problem(
        [
            (expected.isNull(), F.format_string(NOT_ALLOWED, F.col("action"), F.col("status_before"))),
            (reviewing & own, F.lit(SECOND_PERSON)),
            (rationale < MIN_RATIONALE, F.lit(SHORT_RATIONALE)),
            (F.coalesce("actor", F.lit("")) == "", F.lit(NO_ACTOR)),
        ]
    )
    return seen.withColumns({"expected_status": expected, "problem": problem})


def current_status(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest status per key and who last escalated, from the log alone."""
    at = F.struct(*order)
    escalated = F.when(F.col("action") == "ESCALATE", at)
    return log.groupBy(key).agg(
        F.max_by("new_status", at).alias("status"), F.max_by("actor", escalated).alias("escalated_by")
    )


def allowed_actions(status: Column, escalated_by: Column, actor: Column, transitions: dict = TRANSITIONS) -> Column:
    """Actions open to the actor: none on an escalation of their own."""
    none = F.array().cast("array<string>")
    steps = [(s, F.array(*[F.lit(a) for a in actions])) for s, actions in transitions.items()]
    out = F.when(status == steps[0][0], steps[0][1])
    for s, actions in steps[1:]:
        out = out.when(status == s, actions)
    own = (status == "ESCALATED") & F.coalesce(escalated_by == actor, F.lit(False))
    return F.when(own, none).otherwise(F.coalesce(out, none))
