"""Hand-checked cases of the domain results."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import policy
from tidemark.operators import filters, forecast, hotkeys, paging
from tidemark.plans import clinical, factory, inventory, moderation, network, rentals, retail, service, spend, support

D = dt.date(2024, 6, 30)
T = dt.datetime(2024, 6, 1)
TODAY = lambda: F.lit(D)


def hours(n):
    return T + dt.timedelta(hours=n)


def days(n):
    return T + dt.timedelta(days=n)


def history(spark, units, product="p"):
    """Units per consecutive day, ending on D."""
    n = len(units)
    data = [("s", product, D - dt.timedelta(days=n - 1 - i), u) for i, u in enumerate(units) if u is not None]
    return spark.createDataFrame(data, "store_id string, product_id string, sale_date date, units_sold int")


@pytest.mark.parametrize(
    ("units", "expected", "capped", "confidence"),
    [
        ([1] * 28, 30.0, 30.0, "low"),
        ([1] * 30, 30.9, 30.0, "medium"),
        ([1] * 60, 43.7, 30.0, "high"),
        ([0] * 21 + [7] * 7, 84.0, 84.0, "low"),
        ([5], 21.4, 21.4, "low"),
        ([2] * 7 + [None] * 14 + [4] * 7, 108.0, 108.0, "low"),
    ],
)
def test_wma(spark, units, expected, capped, confidence):
    frame = history(spark, units)
    assert rows(forecast.forecast_wma(frame), "forecast_30d_units", "confidence") == [(expected, confidence)]
    assert rows(forecast.forecast_wma(frame, cap_history=True), "forecast_30d_units", "confidence") == [(capped, confidence)]


def test_serving_features_include_both_ends(spark):
    out = forecast.serving_features(history(spark, [1] * 95)).first()
    assert (out.units_7d, out.units_30d, out.units_60d, out.units_90d, out.avg_daily_30d) == (8, 31, 61, 91, 1.0333)


def test_holt_winters(spark):
    week = [10, 12, 9, 11, 20, 30, 25]
    seasonal = forecast.holt_winters_sum(np.array(week * 10, dtype=float), 7, 28)
    assert seasonal == pytest.approx(sum(week) * 4, rel=0.02)
    growing = forecast.holt_winters_sum(np.arange(84, dtype=float) + 50, 7, 30)
    assert growing == pytest.approx(sum(range(134, 164)), rel=0.15)
    frame = history(spark, week * 10, "weekly").unionByName(history(spark, [3] * 10, "short")).unionByName(history(spark, [6, None, 0], "gap"))
    out = {r.product_id: r for r in forecast.forecast_holt_winters(frame, as_of=TODAY()).collect()}
    assert out["weekly"].forecast_30d_units == pytest.approx(sum(week) / 7 * 30, rel=0.06)
    assert (out["weekly"].confidence, out["short"].forecast_30d_units, out["gap"].forecast_30d_units) == ("high", 90.0, 60.0)
    assert rows(forecast.forecast_holt_winters(frame).where("product_id = 'short'"), "forecast_30d_units") == [(90.0,)]


def test_models_by_name(spark):
    frame = history(spark, [2] * 10)

    def broken(daily, n):
        raise RuntimeError

    assert forecast.forecast("mine", frame, plugged={"mine": lambda daily, n: n * 1.0}).first().forecast_30d_units == 10.0
    assert forecast.forecast("mine", frame, plugged={"mine": broken}).first().forecast_30d_units == 60.0
    assert forecast.forecast("weighted_moving_average", frame).first().confidence == "low"
    with pytest.raises(ValueError):
        forecast.forecast("oracle", frame)


def test_replenishment(spark):
    forecasts = spark.createDataFrame(
        [("s", "a", 10.5, "low"), ("s", "b", 11.5, "low"), ("s", "c", 1.0, "low"), ("s", "d", 5.0, "low")],
        "store_id string, product_id string, forecast_30d_units double, confidence string",
    )
    stock = spark.createDataFrame([("s", "a", 0, 0), ("s", "b", 0, 0), ("s", "c", 50, 5)], "store_id string, product_id string, quantity_on_hand int, quantity_on_order int")
    products = spark.createDataFrame([("a", 0), ("b", 0), ("c", 10)], "product_id string, reorder_quantity int")
    out = forecast.replenishment(forecasts, stock, products, "m", F.lit(T))
    assert rows(out, "product_id", "recommended_order_qty") == [("a", 10), ("b", 12), ("c", 0), ("d", 5)]


def test_inventory(spark):
    stock = spark.createDataFrame(
        [("s", p, q, o, T) for p, q, o in [("out", 0, 0), ("half", 5, 0), ("point", 10, 0), ("over", 11, 0), ("coming", 0, 4)]],
        "store_id string, product_id string, quantity_on_hand int, quantity_on_order int, last_counted_at timestamp",
    )
    stores = spark.createDataFrame([("s", "Store", "North", "X"), ("t", "Empty", "South", "Y")], "id string, name string, region string, city string")
    products = spark.createDataFrame([(p, p, p, "c", 100, 10, 5, 3) for p in ("out", "half", "point", "over", "coming")], "id string, sku string, name string, category string, unit_cost_cents int, reorder_point int, reorder_quantity int, lead_time_days int")
    sales = spark.createDataFrame(
        [("s", "half", D - dt.timedelta(days=n), 15, 10) for n in (0, 7, 30, 31, 90, 91)], "store_id string, product_id string, sale_date date, units_sold long, revenue_cents long"
    )
    view = inventory.inventory_overview(stock, stores, products, sales, TODAY())
    status = {r.product_id: r for r in view.collect()}
    assert [status[p].stock_status for p in ("out", "half", "point", "over", "coming")] == ["out_of_stock", "critical", "low", "ok", "out_of_stock"]
    assert (status["half"].units_7d, status["half"].units_30d, float(status["half"].avg_daily_units_30d), float(status["half"].days_of_supply)) == (30, 45, 1.5, 3.3)
    assert status["over"].days_of_supply is None
    assert rows(inventory.low_stock_alerts(view, F.lit(T)), "product_id") == [("half",), ("out",), ("point",)]
    health = inventory.stock_health(view).first()
    assert (health.ok_count, health.low_count, health.critical_count, health.out_of_stock_count, health.inventory_value_cents) == (1, 1, 1, 2, 2600)
    assert [(r.store_id, r.total_skus) for r in inventory.store_health(stores, view).collect()] == [("s", 5), ("t", 0)]
    speed = inventory.sales_velocity(sales, stores, products, TODAY()).first()
    assert (speed.units_7d, speed.units_30d, speed.units_60d, speed.units_90d, speed.revenue_90d_cents) == (30, 45, 60, 75, 50)
    recommended = spark.createDataFrame([("s", "half", 3.0, 5, "high", "m"), ("s", "out", 3.0, 0, "low", "m")], "store_id string, product_id string, forecast_30d_units double, recommended_order_qty int, confidence string, model_used string")
    listed = [r.product_id for r in inventory.store_stock(view, recommended, "s").collect()]
    assert listed == ["coming", "out", "half", "point", "over"]
    orders = spark.createDataFrame([("o1", "s", "half", 1, "pending", 1, T), ("o2", "s", "half", 2, "shipped", 2, T), ("o3", "s", "half", 3, "received", 3, T)], "id string, store_id string, product_id string, quantity_ordered int, status string, ordered_at int, expected_delivery_at timestamp")
    assert rows(inventory.replenishment_queue(recommended, stores, products, stock, orders).orderBy(*inventory.queue_order()), "product_id", "open_order_id") == [("half", "o2")]


def test_daily_revenue_edges(spark):
    orders = spark.createDataFrame([("o1", "u", 1000, days(0)), ("o2", "u", 501, days(0)), ("o3", "u", 700, days(1))], "id string, user_id string, total_in_cents int, created_at timestamp")
    items = spark.createDataFrame([("o1", "m1", 2, 100), ("o1", "m2", 1, 200), ("o2", "mX", 9, 999)], "order_id string, menu_item_id string, quantity int, price_in_cents int")
    menu = spark.createDataFrame([("m1", "tea"), ("m2", "cake")], "id string, category string")
    refunds = spark.createDataFrame([("o1", 50, "approved", days(5)), ("o1", 70, "pending", days(0)), (None, 9, "approved", days(0))], "order_id string, amount_in_cents int, status string, created_at timestamp")
    credits = spark.createDataFrame([(30, days(0)), (99, days(9))], "amount_in_cents int, created_at timestamp")
    out = support.daily_revenue(orders, items, refunds, credits, menu)
    assert rows(out) == [
        (days(0).date(), 2, 1501, 50, 30, 1421, 750, 12, "cake"),
        (days(1).date(), 1, 700, 0, 0, 700, 700, 0, None),
    ]


def test_response_times(spark):
    cases = spark.createDataFrame([("c1", "u", "s", "open", hours(0)), ("c2", "u", "s", "resolved", hours(0))], "id string, user_id string, subject string, status string, created_at timestamp")
    users = spark.createDataFrame([("u", "n", "e", "r")], "id string, name string, email string, region string")
    late = hours(1) + dt.timedelta(minutes=30, seconds=59)
    messages = spark.createDataFrame([("c1", None, hours(1)), ("c1", "a", late), ("c2", None, hours(1))], "case_id string, admin_id string, created_at timestamp")
    none = spark.createDataFrame([], "user_id string, support_case_id string, amount_in_cents int, created_at timestamp, total_in_cents int")
    context = {r.case_id: r for r in support.support_case_context(cases, users, messages, none, none, none, TODAY()).collect()}
    assert (context["c1"].first_response_minutes, context["c2"].first_response_minutes) == (90, None)
    assert (context["c1"].has_admin_reply, context["c2"].has_admin_reply, context["c2"].user_cases_90d) == (True, False, 2)
    answers = spark.createDataFrame([("m1", "c1", "refund", 5, "x", 1), ("m2", "c1", "credit", 6, "y", 2)], "message_id string, case_id string, suggested_action string, suggested_amount_cents int, case_summary string, generated_at int")
    queue = {r.case_id: r for r in support.case_queue(cases, users, messages, answers).collect()}
    assert (queue["c1"].first_response_minutes, queue["c1"].suggested_action, queue["c2"].suggested_action) == (31, "credit", None)
    view = support.support_overview(cases, messages, none, none).first()
    assert (view.avg_messages_per_case, view.avg_first_response_minutes, view.cases_with_refund, view.total_credit_cents) == (1.5, 90.0, 0, 0)


def test_service_equity_by_hand(spark):
    now = F.lit(days(20))
    requests = spark.createDataFrame(
        [("1", days(0), days(2), "CLOSED"), ("2", days(0), days(10), "CLOSED"), ("3", days(11), None, "OPEN"), ("4", days(19), None, "OPEN")],
        "request_id string, created_at timestamp, closed_at timestamp, status string",
    ).withColumns({"category": F.lit("Tree"), "district_id": F.lit(1), "lat": F.lit(1.0), "lon": F.lit(2.0), "department": F.lit("Parks")})
    categories = spark.createDataFrame([("Tree", "Parks", 5)], "category string, department string, sla_days long")
    districts = spark.createDataFrame([(1, "Center", 10), (2, "Quiet", 10)], "district_id long, name string, population long")
    row = service.service_equity(requests, categories, districts, now).collect()
    assert [(r.decided, r.on_time_pct, r.expected_pct, r.gap_pts, r.raw_median_days, r.flagged) for r in row] == [(3, 33.3, 33.3, 0.0, 2.0, False)]
    kpi = service.operations_kpis(requests, categories, now).first()
    assert (kpi.open_requests, kpi.opened_7d, kpi.overdue, kpi.on_time_30d) == (2, 1, 1, 33.3)
    assert service.open_points(requests, categories, now, overdue_only=True).count() == 1
    assert service.lookup(requests, categories, " 3 ").first().sla_days == 5
    facts = {r.request_id: r.facts for r in service.update_facts(requests, categories).collect()}
    assert facts["1"] == "Request 1: Tree (Parks department).\nReported June 01, 2024. Target time to resolve: 5 days.\nResolved on June 03, 2024."


def test_equity_flags_the_slow_district_only(spark):
    rng = random.Random(3)
    data = []
    for i in range(1200):
        district, category = rng.randrange(4), rng.choice(["Fast", "Slow"])
        late = rng.random() < (0.5 if district == 2 else 0.1)
        data.append((i, days(0), days(9 if late else 1), category, district))
    requests = spark.createDataFrame(data, "request_id long, created_at timestamp, closed_at timestamp, category string, district_id long")
    categories = spark.createDataFrame([("Fast", "A", 5), ("Slow", "B", 5)], "category string, department string, sla_days long")
    districts = spark.createDataFrame([(i, str(i), 1) for i in range(4)], "district_id long, name string, population long")
    out = service.service_equity(requests, categories, districts, F.lit(days(30)))
    assert rows(out.where("flagged"), "district_id") == [(2,)]


def shifts(spark, data):
    return spark.createDataFrame(data, "machine_id string, shift_start timestamp, planned_min long, downtime_min long, downtime_reason string, total_units long, scrap_units long")


def test_oee_rolls_up_sums(spark):
    machines = spark.createDataFrame([("A", "L1", "CNC", 60.0), ("B", "L1", "CNC", 60.0)], "machine_id string, line string, machine_type string, ideal_cycle_s double")
    frame = shifts(spark, [("A", days(0), 1000, 0, None, 900, 0), ("B", days(0), 100, 0, None, 20, 0)])
    out = factory.oee(frame, machines, "Line", F.lit(days(1))).first()
    assert out.oee_pct == round(100 * 920 / 1100, 1)
    with pytest.raises(ValueError):
        factory.oee(frame, machines, "Colour", F.lit(days(1)))
    busy = shifts(spark, [("A", days(i), 480, 10 * i, "Breakdown" if i % 2 else "Setup", 400 - i, i) for i in range(6)])
    losses = factory.oee_losses(busy, machines, F.lit(days(9))).first()
    assert sum(losses) == pytest.approx(6 * 480, abs=3)
    parts = factory.oee(busy, machines, "Machine", F.lit(days(9))).first()
    assert parts.oee_pct == pytest.approx(parts.availability_pct * parts.performance_pct * parts.quality_pct / 10_000, abs=0.15)
    shares = factory.loss_shares(factory.oee_losses(busy, machines, F.lit(days(9))), F.lit(6 * 480)).first()
    assert sum(shares) == pytest.approx(100, abs=0.3)


@pytest.mark.parametrize("hot", [1, None])
def test_vibration(spark, hot):
    base = lambda i: 1.0 + 0.1 * (i % 3)
    data = []
    for m, length in (("eleven", 11), ("twelve", 12), ("bridged", 12), ("spike", 1)):
        for i in range(14 * 24 + 40):
            if m == "bridged" and i in (14 * 24 + 7, 14 * 24 + 8):
                continue
            bump = 14 * 24 + 2 <= i < 14 * 24 + 2 + length + (2 if m == "bridged" else 0)
            data.append((m, hours(i), 9.0 if bump else base(i), 50.0))
    data += [("flat", hours(i), 1.0 if i < 330 else 5.0, 50.0) for i in range(14 * 24 + 40)]
    frame = spark.createDataFrame(data, "machine_id string, ts timestamp, vibration_rms double, temperature_c double")
    scored = factory.vibration_scored(frame, hot=hot)
    found = factory.alert_episodes(scored, hot=hot)
    start = 14 * 24 + 2
    assert rows(found) == [("bridged", hours(start + 13), hours(start + 13), 1), ("twelve", hours(start + 11), hours(start + 11), 1)]
    machines = spark.createDataFrame([(m, "L", "CNC") for m in ("eleven", "twelve", "spike", "flat", "none")], "machine_id string, line string, machine_type string")
    status = dict(rows(factory.machine_status(scored, machines, hours=48, hot=hot), "machine_id", "status"))
    assert status == {"eleven": "WATCH", "twelve": "ALERT", "spike": "OK", "flat": "OK"}
    repairs = spark.createDataFrame([("twelve", hours(start + 11), "CORRECTIVE"), ("twelve", hours(start + 59), "CORRECTIVE"), ("twelve", hours(start + 20), "PREVENTIVE")], "machine_id string, ts timestamp, type string")
    assert rows(factory.lead_times(found, repairs, hot=hot), "machine_id", "lead_days") == [("twelve", 2.0)]


KPI = "site_id string, ts timestamp, availability_pct double, drop_call_rate_pct double"


@pytest.mark.parametrize("hot", [1, None])
def test_incidents(spark, hot):
    def at(i):
        return T + dt.timedelta(minutes=15 * i)

    def series(site, bad, n=10):
        return [(site, at(i), *bad.get(i, (99.9, 0.1))) for i in range(n)]

    kpis = spark.createDataFrame(
        series("single", {3: (10.0, 0.0)}) + series("edge", {3: (95.0, 2.0), 4: (95.0, 2.0)}) + series("deg", {3: (50.0, 0.0), 4: (99.0, 2.1)})
        + series("out", {2: (49.9, 0.0), 3: (80.0, 0.0), 8: (90.0, 0.0), 9: (90.0, 0.0)}),
        KPI,
    )
    sites = spark.createDataFrame([(s, "area") for s in ("single", "edge", "deg", "out")], "site_id string, area string")
    found = network.incidents(kpis, sites, hot=hot)
    assert rows(found, "incident_id", "kind", "ended_at", "duration_min", "ongoing") == [
        ("deg-202406010045", "DEGRADATION", at(5), 30, False),
        ("out-202406010030", "OUTAGE", at(4), 30, False),
        ("out-202406010200", "DEGRADATION", at(10), 30, True),
    ]
    customers = spark.createDataFrame([(1, "a", "BUSINESS", 150.0, 1, "out"), (2, "b", "BASIC", 30.0, 1, "deg"), (3, "c", "BASIC", 30.0, 1, "edge")], "customer_id long, first_name string, plan string, monthly_charge double, tenure_months long, home_site_id string")
    ticket = at(5) + dt.timedelta(hours=24)
    tickets = spark.createDataFrame([(2, ticket), (2, at(3)), (1, at(0))], "customer_id long, opened_at timestamp")
    impact = network.with_policy(network.incident_impact(found, customers, tickets))
    assert rows(impact, "incident_id", "customer_id", "incidents_in_period", "opened_ticket", "churn_risk") == [
        ("deg-202406010045", 2, 1, True, "HIGH"),
        ("out-202406010030", 1, 2, False, "HIGH"),
        ("out-202406010200", 1, 2, False, "HIGH"),
    ]
    late = spark.createDataFrame([(2, ticket + dt.timedelta(seconds=1))], "customer_id long, opened_at timestamp")
    assert network.incident_impact(found, customers, late, ["deg-202406010045"]).first().opened_ticket is False
    queued = network.queue_messages(impact.where("customer_id = 1"), found, "me", F.lit(T))
    assert rows(network.outreach_audience(impact, queued), "customer_id") == [(2,)]
    assert rows(network.outreach_summary(queued), "messages", "credits") == [(1, 0.0), (1, 0.0)]
    assert network.recent_kpis(kpis, site_id="out").count() == 10


@pytest.mark.parametrize(
    ("plan", "monthly", "kind", "minutes", "credit"),
    [("BASIC", 60.0, "OUTAGE", 59, 0.0), ("BASIC", 60.0, "OUTAGE", 90, 2.0), ("BASIC", 60.0, "OUTAGE", 360, 4.0), ("BUSINESS", 150.0, "OUTAGE", 240, 10.0),
     ("BASIC", 30.0, "OUTAGE", 20 * 1440, 15.0), ("BASIC", 30.0, "DEGRADATION", 900, 0.0)],
)
def test_credit_policy(spark, plan, monthly, kind, minutes, credit):
    frame = spark.createDataFrame([(plan, monthly, kind, minutes)], "p string, m double, k string, d long")
    assert frame.select(policy.service_credit(F.col("p"), F.col("m"), F.col("k"), F.col("d")).alias("c")).first().c == credit


def test_small_policies(spark):
    frame = spark.createDataFrame([("ALERT", False), ("WATCH", True), ("OK", True)], "s string, c boolean")
    assert [r[0] for r in frame.select(policy.work_priority(F.col("s"))).collect()] == ["HIGH", "MEDIUM", "LOW"]
    assert [r[0] for r in frame.select(policy.model_permission(F.col("c"))).collect()] == [True, False, False]
    assert [r[0] for r in frame.select(policy.model_permission(F.col("c"), True)).collect()] == [True, True, True]


def retail_tables(spark):
    def ago(n):
        return D - dt.timedelta(days=n)

    orders = spark.createDataFrame(
        [("A", 1, ago(40), "DELIVERED", ago(30), 10.0), ("B", 1, ago(40), "DELIVERED", ago(31), 20.0), ("C", 2, ago(70), "DELIVERED", ago(60), 30.0), ("D", 2, ago(70), "DELIVERED", ago(61), 40.0),
         ("E", 1, ago(2), "SHIPPED", None, 50.0), ("F", 1, ago(9), "DELIVERED", ago(1), 60.0), ("G", 1, ago(9), "DELIVERED", ago(2), 70.0)],
        "order_id string, customer_id long, order_date date, status string, delivered_date date, total double",
    )
    items = spark.createDataFrame([(o, 1, 1, 5.0) for o in "ABCDE"] + [("A", 2, 1, 5.0), ("F", 2, 1, 5.0), ("G", 1, 1, 5.0), ("G", 1, 1, 5.0)], "order_id string, product_id long, quantity long, unit_price double")
    products = spark.createDataFrame([(1, "Mug", "Kitchen", 5.0, True), (2, "Vest", "Wear", 9.0, False)], "product_id long, name string, category string, price double, returnable boolean")
    returns = spark.createDataFrame([("r1", "G", "broken", "REQUESTED", D), ("r2", "G", "again", "DONE", D)], "return_id string, order_id string, reason string, status string, requested_at date")
    customers = spark.createDataFrame([(1, "n", "N@x.org", "SILVER"), (2, "g", "g@x.org", "GOLD")], "customer_id long, name string, email string, loyalty_tier string")
    return orders, items, products, returns, customers


def test_return_eligibility(spark):
    out = {r.order_id: (r.eligible, r.reason) for r in retail.return_eligibility(*retail_tables(spark), TODAY()).collect()}
    assert out["A"] == (True, f"Returnable until {D} (30-day window).{retail.EXCLUSION_NOTE}")
    assert out["B"] == (False, f"The 30-day return window ended on {D - dt.timedelta(days=1)}.")
    assert out["C"] == (True, f"Returnable until {D} (60-day window).")
    assert out["D"][0] is False
    assert out["E"] == (False, "Order is shipped, not delivered yet.")
    assert out["F"] == (False, retail.FINAL_SALE)
    assert out["G"] == (False, retail.ALREADY_REQUESTED)


def test_retail_reports(spark):
    orders, items, products, returns, customers = retail_tables(spark)
    kpi = retail.retail_kpis(orders, returns, TODAY()).first()
    assert (kpi.orders_30d, kpi.revenue_30d, kpi.open_returns, kpi.return_rate_pct) == (3, 180.0, 1, 16.7)
    assert rows(retail.return_rate_by_category(items, products, orders, returns)) == [("Kitchen", 20.0), ("Wear", 0.0)]
    assert rows(retail.late_deliveries(orders), "order_id") == [("A",), ("B",), ("C",), ("D",), ("F",)]
    assert [r.order_id for r in retail.newest(retail.late_deliveries(orders), "order_date", "order_id", 2).collect()] == ["F", "A"]
    assert rows(retail.open_returns(returns, orders, customers), "return_id", "email") == [("r1", "N@x.org")]
    assert retail.find_customer(customers, " n@X.org ").first().customer_id == 1
    assert [r.order_id for r in retail.recent_orders(orders, 1, 2).collect()] == ["E", "F"]
    one = retail.order_details(orders, customers, items, products, returns, " g ").collect()
    assert len(one) == 1 and one[0]["items"][0]["lines"] == 2 and len(one[0]["returns"]) == 2
    assert rows(retail.search_products(products, "KITCH"), "name") == [("Mug",)]
    assert retail.search_products(products, "e", max_price=6).count() == 1
    policies = spark.createDataFrame([("returns", "30 days")], "topic string, content string")
    assert retail.policy_text(policies, "returns").first().content == "30 days"
    assert retail.policy_text(policies, "space").first().content == "No policy found for 'space'."


def test_cohort(spark):
    admissions = spark.createDataFrame([(1, 10, 90, "URGENT", 1, 2.0, T), (1, 11, 30, "URGENT", 0, 4.0, T), (2, 12, 39, "EW", 0, 9.0, T)], "subject_id long, hadm_id long, age int, admission_type string, hospital_expire_flag int, los_days double, admittime timestamp")
    dx = spark.createDataFrame([(10, 1, "I50", "Heart failure"), (11, 1, "4280", None), (12, 1, "A41", "Sepsis")], "hadm_id long, seq_num int, icd_code string, long_title string")
    icu = spark.createDataFrame([(10,)], "hadm_id long")
    pick = lambda **k: rows(clinical.cohort(admissions, dx, icu, **k), "hadm_id")
    assert pick(diagnosis="heart") == [(10,)]
    assert pick(diagnosis="428.0") == [(11,)]
    assert pick(diagnosis="i5") == [(10,)]
    assert pick(age=(30, 39)) == [(11,), (12,)]
    assert pick(types=["EW"]) == [(12,)]
    assert pick(icu_only=True) == [(10,)]
    stats = clinical.cohort_stats(admissions).first()
    assert (stats.patients, stats.admissions, stats.mortality_pct, stats.median_los) == (2, 3, 33.3, 4.0)
    assert rows(clinical.age_histogram(admissions)) == [(30, 2), (90, 1)]
    assert [r.diagnosis for r in clinical.top_diagnoses(admissions, dx, 2).collect()] == ["4280", "Heart failure"]
    assert [r.hadm_id for r in clinical.listing(admissions, 2).collect()] == [10, 11]
    labs = spark.createDataFrame([(10, hours(1), "Na", 2.0, None, "mg"), (10, hours(0), "Na", 1.0, None, "mg")], "hadm_id long, charttime timestamp, label string, valuenum double, flag string, valueuom string")
    assert [r.valuenum for r in clinical.lab_trend(labs, 10, "Na").collect()] == [1.0, 2.0]


SUBS = "id string, name string, category string, cost_cents int, billing_cycle string, status string, renewal_date date"


def test_spend(spark):
    soon = lambda n: D + dt.timedelta(days=n)
    subs = spark.createDataFrame(
        [("1", "a", "Sales", 1000, "annual", "active", soon(0)), ("2", "b", "Sales", 500, "monthly", "trial", soon(30)), ("3", "c", "HR", 900, "one_time", "active", soon(31)),
         ("4", "d", "HR", 700, "monthly", "cancelled", soon(5)), ("5", "e", "HR", 700, "monthly", "pending_cancellation", None)],
        SUBS,
    )
    assert rows(spend.spend_by_category(subs)) == [("HR", 1, 0), ("Sales", 2, 583)]
    view = spend.spend_overview(subs, TODAY()).first()
    assert tuple(view) == (3, 1, 583, 7000, 2)
    assert [r.id for r in subs.orderBy(*spend.listing_order()).collect()] == ["1", "3", "2", "5", "4"]
    bad = spark.createDataFrame(
        [("a", "v", "Sales", -1, "weekly", "active", "o", "not an address", None, D), ("a", "v", "Sales", 1, "annual", "active", "o", "o@x.org", 1, D)],
        "name string, vendor string, category string, cost_cents int, billing_cycle string, status string, owner_name string, owner_email string, license_count int, start_date date",
    )
    good, rejected = filters.quarantine(bad, spend.subscription_violations())
    assert good.count() == 1
    assert rejected.first().violations == ["billing_cycle", "cost_cents", "owner_email"]


def test_moderation(spark):
    submissions = spark.createDataFrame([("s1", "t", "b", "blog", "pending_review", 1, 1), ("s2", "t", "b", "blog", "approved", 2, 2), ("s3", "t", "b", "twitter", "rejected", 3, 3)], "id string, title string, body string, target string, status string, created_at int, updated_at int")
    analyses = spark.createDataFrame([("a1", "s1", 40, "[]", 1), ("a2", "s1", 80, "[x]", 2), ("a3", "s2", 61, "[]", 1)], "id string, submission_id string, compliance_score int, issues string, analyzed_at int")
    assert tuple(moderation.content_overview(submissions, analyses).first()) == (3, 1, 1, 1, 0, 71.0)
    assert rows(moderation.submissions_by_target(submissions, analyses)) == [("blog", 2, 1, 71.0), ("twitter", 1, 0, 0.0)]
    assert [(r.id, r.compliance_score) for r in moderation.review_queue(submissions, analyses).collect()] == [("s1", 80), ("s2", 61), ("s3", None)]
    targets = spark.createDataFrame([(t,) for t in moderation.TARGETS], "target string")
    guidelines = spark.createDataFrame([("g2", "blog", "B", "two", True, 2), ("g1", "blog", "A", "one", True, 1), ("g3", "twitter", "C", "x", False, 1)], "id string, target string, title string, rules string, is_active boolean, created_at int")
    counts = {r.target: (r.active_guidelines, r.total_guidelines) for r in moderation.guideline_counts(targets, guidelines).collect()}
    assert counts == {"blog": (2, 2), "twitter": (0, 1), "linkedin": (0, 0), "newsletter": (0, 0), "press_release": (0, 0)}
    prompts = moderation.guideline_prompt(submissions, guidelines).collect()
    assert {r.id for r in prompts} == {"s1", "s2"} and "## A\none\n\n## B\ntwo" in prompts[0].prompt
    reviews = spark.createDataFrame([("r1", "s1", "approved", 5), ("r2", "s1", "rejected", 6)], "id string, submission_id string, decision string, created_at int")
    assert rows(moderation.apply_reviews(submissions, reviews), "id", "status", "updated_at") == [("s1", "rejected", 6), ("s2", "approved", 2), ("s3", "rejected", 3)]


def test_rentals(spark):
    bookings = spark.createDataFrame([(1, 1, 1, 100.0), (2, 1, 1, 50.0)], "booking_id long, user_id long, property_id long, total_amount double")
    properties = spark.createDataFrame([(1, "Hut", 9)], "property_id long, title string, destination_id long")
    places = spark.createDataFrame([(9, "Alps", "CH")], "destination_id long, destination string, country string")
    reviews = spark.createDataFrame([(1, 5), (1, 4)], "booking_id long, rating int")
    assert rows(rentals.revenue_by_destination(bookings, properties, places, reviews)) == [("Alps", "CH", 2, 250.0, 4.5)]
    assert rows(rentals.revenue_by_destination(bookings, properties, places, reviews, dedupe=True)) == [("Alps", "CH", 2, 150.0, 4.5)]
    trips = spark.createDataFrame([(1, 2, 10.0), (1, 2, 20.0)], "pickup_zip int, dropoff_zip int, fare_amount double")
    assert rentals.expected_fare(trips, 1, 2).first().fare == 15.0
    assert rentals.expected_fare(trips, 5, 5).first().fare == 99.0
    assert [r.month for r in rentals.months_until(rentals.sample_months(spark), 2).collect()] == ["January", "February"]


def test_keyset_pages(spark):
    chats = spark.createDataFrame([(i, i // 2) for i in range(10)], "id long, at long")
    first = paging.keyset_page(chats, "at", "id", 3).collect()
    assert [(r.id, r.has_more) for r in first] == [(9, True), (8, True), (7, True)]
    older = paging.keyset_page(chats, "at", "id", 3, before=(1, 3)).collect()
    assert [(r.id, r.has_more) for r in older] == [(2, False), (1, False), (0, False)]
    newer = paging.keyset_page(chats, "at", "id", 3, after=(0, 1)).collect()
    assert [r.id for r in newer] == [9, 8, 7]


def test_search_and_bands(spark):
    frame = spark.createDataFrame([(1, "Ann%", None, "x"), (2, "ben", "ANNEX", "y"), (3, None, None, "x")], "id long, a string, b string, c string")
    assert rows(filters.search_any(frame, ["a", "b"], " ANN"), "id") == [(1,), (2,)]
    assert rows(filters.search_any(frame, ["a", "b"], "", {"c": ["x"]}), "id") == [(1,), (3,)]
    assert rows(filters.typeahead(frame, "a", "ann%", 5, ["id"]), "id") == [(1,)]
    assert filters.optional(frame, "c", "All").count() == 3
    ages = spark.createDataFrame([(n,) for n in (0, 7, 8, 14, 15, 30, 31)], "n int")
    band = filters.right_closed_bands(F.col("n"), [-1, 7, 14, 30, 10_000], ["0-7", "8-14", "15-30", ">30"])
    assert [r[0] for r in ages.select(band).collect()] == ["0-7", "0-7", "8-14", "8-14", "15-30", "15-30", ">30"]
    flags = spark.createDataFrame([(1, None), (None, 5)], "admin_id long, n long")
    assert [r[0] for r in flags.select(filters.thread_role()).collect()] == ["admin", "customer"]


def test_item_pages_deal_rows_by_size(spark):
    """Alike products are one item with all its lines, and tasks get about the same rows however many there are."""
    products = spark.createDataFrame([(1, "ring", "gold", True), (2, "ring", "gold", True), (3, "pin", "gold", True)], "product_id long, name string, category string, returnable boolean")
    items = spark.range(3_000).selectExpr("id % 1000 AS order_id", "1 + id div 1000 AS product_id", "2L AS quantity", "1.5D AS unit_price")
    pages = retail.item_pages(items, products)
    assert {(r.page, tuple((i["name"], i["lines"]) for i in r["items"])) for r in pages.collect()} == {(0, (("pin", 1), ("ring", 2)))}
    assert pages.count() == 1_000
    per_task = hotkeys.dealt(items, ["order_id"], 3_000, 100).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(per_task) >= 25 and max(r["count"] for r in per_task) < 300
