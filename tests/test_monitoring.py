"""Boundary rows of the rules, with and without split customers, and the decision workflow."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import workflow
from tidemark.plans import monitoring as m

T0 = dt.datetime(2024, 3, 1, 12)
SCHEMA = "txn_id string, customer_id long, ts timestamp_ntz, type string, amount_cents long, counterparty_country string"
HOT = pytest.mark.parametrize("hot", [1, None])


def days(n, seconds=0):
    return T0 + dt.timedelta(days=n, seconds=seconds)


def frame(spark, data):
    return spark.createDataFrame([(*r, "US") if len(r) == 5 else r for r in data], SCHEMA)


def deposit(i, c, ts, dollars):
    return (f"t{i}", c, ts, "CASH_DEPOSIT", round(dollars * 100))


@HOT
def test_structuring(spark, hot):
    txns = frame(
        spark,
        [
            deposit(1, 1, days(0), 8000), deposit(2, 1, days(3), 9999.99), deposit(3, 1, days(7), 9000),
            deposit(4, 2, days(0), 8000), deposit(5, 2, days(3), 9000), deposit(6, 2, days(7, 1), 9000),
            deposit(7, 3, days(0), 7999.99), deposit(8, 3, days(1), 10000), deposit(9, 3, days(1), 9000), deposit(10, 3, days(2), 9000),
            deposit(11, 4, days(0), 9000), deposit(12, 4, days(0), 9000), deposit(13, 4, days(0), 9000), deposit(14, 4, days(60), 9000),
            deposit(15, 1, days(14), 9000), deposit(16, 1, days(14, 1), 9000),
        ],
    )
    hits = m.structuring(txns, hot=hot)
    # Customer 1: days 0, 3 and 7 fall in one window; 7, 14 in another of two only, with the one a second later outside.
    assert rows(hits.evidence, "customer_id", "txn_id") == [(1, "t1"), (1, "t2"), (1, "t3"), (4, "t11"), (4, "t12"), (4, "t13")]
    summary = {r.customer_id: r for r in hits.summary.collect()}
    assert summary[1].total_cents == 800_000 + 999_999 + 900_000
    assert (summary[1].first_ts, summary[1].last_ts) == (days(0), days(7))


@HOT
def test_rapid_movement(spark, hot):
    hour = dt.timedelta(hours=1)
    txns = frame(
        spark,
        [
            ("in1", 1, T0, "WIRE_IN", 2_000_000), ("o1", 1, T0 + 48 * hour, "WIRE_OUT", 1_600_000),
            ("in2", 2, T0, "WIRE_IN", 2_000_000), ("o2", 2, T0, "ACH_OUT", 2_000_000),
            ("in3", 3, T0, "WIRE_IN", 2_000_000), ("o3", 3, T0 + 48 * hour + dt.timedelta(seconds=1), "WIRE_OUT", 2_000_000),
            ("in4", 4, T0, "WIRE_IN", 1_999_999), ("o4", 4, T0 + hour, "WIRE_OUT", 1_999_999),
            ("in5", 5, T0, "WIRE_IN", 2_000_000), ("o5", 5, T0 + hour, "WIRE_OUT", 1_599_999),
            ("in6", 6, T0, "WIRE_IN", 3_000_000), ("in7", 6, T0 + hour, "WIRE_IN", 2_000_000),
            ("o6", 6, T0 + 2 * hour, "ACH_OUT", 2_400_000), ("o7", 6, T0 + 3 * hour, "CARD", 900_000),
        ],
    )
    hits = m.rapid_movement(txns, hot=hot)
    assert rows(hits.summary, "customer_id", "total_cents", "n_evidence") == [(1, 2_000_000, 2), (6, 5_000_000, 3)]
    assert rows(hits.evidence.where("customer_id = 6"), "txn_id") == [("in6",), ("in7",), ("o6",)]
    assert rows(hits.summary.where("customer_id = 6"), "first_ts", "last_ts") == [(T0, T0 + 2 * hour)]


def test_jurisdiction(spark):
    data = [
        ("a", 1, T0, "WIRE_IN", 600_000, "IR"), ("b", 1, T0, "WIRE_OUT", 400_000, "YE"), ("c", 1, T0, "ACH_OUT", 900_000, "IR"),
        ("d", 2, T0, "WIRE_OUT", 999_999, "KP"), ("e", 3, T0, "WIRE_IN", 5_000_000, "US"),
    ]
    hits = m.high_risk_jurisdiction(frame(spark, data))
    assert rows(hits.evidence, "txn_id") == [("a",), ("b",)]
    assert rows(hits.summary, "customer_id", "total_cents") == [(1, 1_000_000)]


@HOT
def test_dormant(spark, hot):
    data = [
        ("a", 1, days(0), "CARD", 100), ("b", 1, days(60), "CARD", 1_000_000), ("c", 1, days(67), "CARD", 1_500_000), ("d", 1, days(67, 1), "CARD", 9),
        ("e", 2, days(0), "CARD", 100), ("f", 2, days(59, 86_399), "CARD", 9_000_000),
        ("g", 3, days(0), "CARD", 9_000_000),
        ("h", 4, days(0), "CARD", 1), ("i", 4, days(70), "CARD", 2_000_000), ("j", 4, days(70), "CARD", 500_000),
    ]
    hits = m.dormant_reactivation(frame(spark, data), hot=hot)
    assert rows(hits.evidence, "customer_id", "txn_id") == [(1, "b"), (1, "c"), (4, "i"), (4, "j")]
    assert rows(hits.summary, "customer_id", "total_cents", "last_ts") == [(1, 2_500_000, days(67)), (4, 2_500_000, days(70))]


@HOT
def test_round_amounts(spark, hot):
    data = [(f"a{i}", 1, days(i * 7), "WIRE_OUT", 500_000) for i in range(5)] + [(f"b{i}", 2, days(i), "ACH_OUT", 600_000) for i in range(4)]
    data += [("b9", 2, days(1), "ACH_OUT", 550_000), ("b8", 2, days(1), "WIRE_IN", 600_000)]
    assert rows(m.round_amounts(frame(spark, data), hot=hot).summary, "customer_id", "n_evidence") == [(1, 5)]


def test_scores(spark):
    customers = spark.createDataFrame(
        [(1, "a", "HIGH", True), (2, "b", "MEDIUM", False), (3, "c", "LOW", None)], "customer_id long, name string, risk_rating string, pep boolean"
    )
    txns = frame(spark, [deposit(f"{c}-{i}", c, days(i), 9000) for c in (1, 2, 3) for i in range(3)])
    alerts = m.score_alerts(m.run_rules(txns), customers)
    assert rows(alerts, "alert_id", "score") == [("AL-STRUCTURING-1", 100), ("AL-STRUCTURING-2", 81), ("AL-STRUCTURING-3", 70)]
    assert {r.total_amount for r in alerts.collect()} == {27000.0}
    pages = m.evidence_lists(m.alert_evidence(m.run_rules(txns)))
    assert pages.where("page = 0 AND size(evidence_txn_ids) = 3").count() == pages.count() == 3
    assert m.rules_catalog(spark).count() == 5


LOG = "event_id long, alert_id string, action string, new_status string, actor string, rationale string, ai_draft_used boolean, decided_at timestamp_ntz"
GOOD = "The pattern has no documented purpose."


def log(spark, steps):
    return spark.createDataFrame(
        [(i, "A", action, status, actor, why, False, days(i)) for i, (action, status, actor, why) in enumerate(steps)], LOG
    )


@HOT
def test_workflow(spark, hot):
    seen = workflow.replay_workflow(
        log(
            spark,
            [
                ("ESCALATE", "ESCALATED", "kim", GOOD),
                ("APPROVE_SAR", "SAR_APPROVED", "kim", GOOD),
                ("RETURN", "RETURNED", "lead", GOOD),
                ("CLOSE_EXPLAINED", "CLOSED_EXPLAINED", "kim", "   short   "),
                ("ESCALATE", "ESCALATED", "kim", GOOD),
            ],
        ),
        "alert_id",
        ["decided_at", "event_id"],
        hot=hot,
    )
    assert [r.problem for r in seen.orderBy("event_id").collect()] == [
        None,
        workflow.SECOND_PERSON,
        "Can't RETURN an alert that is SAR_APPROVED.",
        workflow.SHORT_RATIONALE,
        "Can't ESCALATE an alert that is CLOSED_EXPLAINED.",
    ]
    clean = [("ESCALATE", "ESCALATED", "kim", GOOD), ("RETURN", "RETURNED", "lead", GOOD), ("CLOSE_EXPLAINED", "CLOSED_EXPLAINED", "kim", GOOD)]
    assert workflow.replay_workflow(log(spark, clean), "alert_id", ["decided_at", "event_id"]).where("problem IS NOT NULL").count() == 0
    assert workflow.replay_workflow(log(spark, [("ESCALATE", "X", "", GOOD)]), "alert_id", ["decided_at"]).first().problem == workflow.NO_ACTOR


def test_allowed_actions(spark):
    state = workflow.current_status(log(spark, [("ESCALATE", "ESCALATED", "kim", GOOD)]), "alert_id", ["decided_at"])
    for actor, expected in (("kim", []), ("lead", ["APPROVE_SAR", "RETURN"])):
        assert state.select(workflow.allowed_actions(F.col("status"), F.col("escalated_by"), F.lit(actor)).alias("a")).first().a == expected
    opened = spark.createDataFrame([("OPEN",), ("SAR_APPROVED",)], "s string")
    got = [r.a for r in opened.select(workflow.allowed_actions(F.col("s"), F.lit(None).cast("string"), F.lit("x")).alias("a")).collect()]
    assert got == [["ESCALATE", "CLOSE_FALSE_POSITIVE", "CLOSE_EXPLAINED"], []]
