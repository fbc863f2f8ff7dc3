"""Stock, sales velocity, alerts and replenishment views. `as_of` stands for today's date.

"30 days" takes dates from as_of - 30 on, as_of included, and divides by 30.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import since, trailing_totals
from ..operators.filters import ladder, rank_of
from ..operators.joins import pick_child, spine_join
from ..operators.maintenance import update_by_key

PAIR = ["store_id", "product_id"]
STATUS_ORDER = ["out_of_stock", "critical", "low"]
CONFIDENCE_ORDER = ["high", "medium"]


def _stores(stores: DataFrame, *more: str) -> DataFrame:
    return stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), "region", *more)


def _products(products: DataFrame, *more: str) -> DataFrame:
    return products.select(F.col("id").alias("product_id"), "sku", F.col("name").alias("product_name"), "category", *more)


def stock_status(on_hand: Column, reorder_point: Column) -> Column:
    """out_of_stock at 0 or below, critical up to half the reorder point, low up to it, else ok."""
    return ladder(
        [(on_hand <= 0, "out_of_stock"), (on_hand <= reorder_point * F.lit(0.5), "critical"), (on_hand <= reorder_point, "low")],
        "ok",
    )


def inventory_overview(
    stock: DataFrame, stores: DataFrame, products: DataFrame, daily_sales: DataFrame, as_of: Column
) -> DataFrame:
    """Stock per store and product with recent sales, days of supply and status."""
    recent = daily_sales.where(since("sale_date", as_of, 30))
    sold = recent.groupBy(*PAIR).agg(
        F.sum("units_sold").alias("units_30d"),
        F.sum(F.when(since("sale_date", as_of, 7), F.col("units_sold")).otherwise(0)).alias("units_7d"),
    )
    with_sales = spine_join(stock, [sold], PAIR, {"units_30d": 0, "units_7d": 0})
    average = F.col("units_30d") / F.lit(30.0)
    return (
        with_sales.join(_stores(stores), "store_id")
        .join(_products(products, "unit_cost_cents", "reorder_point", "reorder_quantity", "lead_time_days"), "product_id")
        .withColumn("avg_daily_units_30d", average)
        .select(
            "store_id", "store_name", "region", "product_id", "sku", "product_name", "category",
            "unit_cost_cents", "reorder_point", "reorder_quantity", "lead_time_days",
            "quantity_on_hand", "quantity_on_order", "last_counted_at",
            "avg_daily_units_30d", "units_7d", "units_30d",
            F.when(
                F.col("avg_daily_units_30d") > 0, F.round(F.col("quantity_on_hand") / F.col("avg_daily_units_30d"), 1)
            ).alias("days_of_supply"),
            stock_status(F.col("quantity_on_hand"), F.col("reorder_point")).alias("stock_status"),
        )
    )


def low_stock_alerts(overview: DataFrame, alerted_at: Column) -> DataFrame:
    """Rows short of stock with nothing on order."""
    short = F.col("stock_status").isin(STATUS_ORDER) & (F.col("quantity_on_order") == 0)
    return overview.where(short).select(
        "store_id", "store_name", "region", "product_id", "sku", "product_name", "category",
        "quantity_on_hand", "quantity_on_order", "reorder_point", "reorder_quantity", "lead_time_days",
        "avg_daily_units_30d", "days_of_supply", "stock_status", alerted_at.alias("alerted_at"),
    )


def sales_velocity(daily_sales: DataFrame, stores: DataFrame, products: DataFrame, as_of: Column) -> DataFrame:
    """Units, averages and revenue over trailing windows, per store and product that ever sold.

    The windows are summed per key before names are joined on.
    """
    sums = trailing_totals(
        daily_sales, PAIR, "sale_date", {"units_sold": "units", "revenue_cents": "revenue"}, [7, 30, 60, 90], as_of
    )
    return (
        sums.join(_stores(stores), "store_id")
        .join(_products(products), "product_id")
        .select(
            "store_id", "store_name", "region", "product_id", "sku", "product_name", "category",
            "units_7d", "units_30d", "units_60d", "units_90d",
            F.round(F.col("units_30d") / F.lit(30.0), 2).alias("avg_daily_30d"),
            F.round(F.col("units_7d") / F.lit(7.0), 2).alias("avg_daily_7d"),
            F.col("revenue_30d").alias("revenue_30d_cents"),
            F.col("revenue_90d").alias("revenue_90d_cents"),
        )
    )


def _status_counts(of: Column) -> list[Column]:
    return [F.count_if(of == s).alias(f"{s}_count") for s in ["ok", "low", "critical", "out_of_stock"]]


def stock_health(overview: DataFrame) -> DataFrame:
    """One row: rows per status, stores, products, stock value."""
    return overview.agg(
        *_status_counts(F.col("stock_status")),
        F.countDistinct("store_id").alias("store_count"),
        F.countDistinct("product_id").alias("product_count"),
        F.sum(F.col("quantity_on_hand") * F.col("unit_cost_cents")).alias("inventory_value_cents"),
    )


def store_health(stores: DataFrame, overview: DataFrame) -> DataFrame:
    """Status counts per store, stores without stock included, most urgent first."""
    counts = overview.groupBy("store_id").agg(F.count("product_id").alias("total_skus"), *_status_counts(F.col("stock_status")))
    names = [c for c in counts.columns if c != "store_id"]
    out = spine_join(_stores(stores, "city"), [counts], ["store_id"], {n: 0 for n in names})
    return out.orderBy((F.col("critical_count") + F.col("out_of_stock_count")).desc(), "store_name", "store_id")


def with_recommendation(stock: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Stock rows with their replenishment recommendation, when there is one."""
    chosen = recommendations.select(*PAIR, "forecast_30d_units", "recommended_order_qty", "confidence", "model_used")
    return stock.join(chosen, PAIR, "left")


def by_urgency() -> list[Column]:
    """Order of stock lists: status, then shortest supply (unknown last), then keys."""
    return [rank_of(F.col("stock_status"), STATUS_ORDER), F.col("days_of_supply").asc_nulls_last(), F.col("store_id"), F.col("product_id")]


def store_stock(overview: DataFrame, recommendations: DataFrame, store_id) -> DataFrame:
    """Stock list of one store, most urgent first."""
    return with_recommendation(overview.where(F.col("store_id") == store_id), recommendations).orderBy(*by_urgency())


def alert_list(alerts: DataFrame, recommendations: DataFrame, n: int = 500) -> DataFrame:
    """The n most urgent alerts with recommendations: the report's own top n."""
    return with_recommendation(alerts, recommendations).orderBy(*by_urgency()).limit(n)


def replenishment_queue(
    recommendations: DataFrame, stores: DataFrame, products: DataFrame, stock: DataFrame, orders: DataFrame
) -> DataFrame:
    """Recommendations to order something, with stock and the newest order still open."""
    wanted = recommendations.where(F.coalesce("recommended_order_qty", F.lit(0)) > 0)
    live = orders.where(~F.col("status").isin("received", "cancelled")).select(
        *PAIR, "ordered_at",
        F.col("id").alias("open_order_id"),
        F.col("status").alias("open_order_status"),
        F.col("quantity_ordered").alias("open_order_qty"),
        "expected_delivery_at",
    )
    columns = ["open_order_id", "open_order_status", "open_order_qty", "expected_delivery_at"]
    with_order = pick_child(wanted, live, PAIR, ["ordered_at", "open_order_id"], columns)
    held = stock.select(*PAIR, "quantity_on_hand", "quantity_on_order")
    return (
        spine_join(with_order, [held], PAIR, {"quantity_on_hand": 0, "quantity_on_order": 0})
        .join(_stores(stores), "store_id")
        .join(_products(products, "lead_time_days"), "product_id")
    )


def queue_order() -> list[Column]:
    """Surest forecasts first, then the largest orders, then keys."""
    return [rank_of(F.col("confidence"), CONFIDENCE_ORDER), F.col("recommended_order_qty").desc(), F.col("store_id"), F.col("product_id")]


def recent_orders(orders: DataFrame, stores: DataFrame, products: DataFrame, n: int = 100) -> DataFrame:
    """The newest orders with names. The cut comes before the joins: every order has a store and product."""
    newest = orders.orderBy(F.col("ordered_at").desc(), "id").limit(n)
    return newest.join(_stores(stores), "store_id").join(_products(products), "product_id")


def forecast_summary(recommendations: DataFrame) -> DataFrame:
    """Per confidence: how many, average forecast and order quantity."""
    return recommendations.groupBy("confidence").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("forecast_30d_units"), 1).alias("avg_forecast_30d"),
        F.round(F.avg("recommended_order_qty"), 0).alias("avg_recommended_qty"),
    )


def receive_orders(stock: DataFrame, received: DataFrame, now: Column) -> DataFrame:
    """Stock after deliveries: on hand grows, on order shrinks but not below zero."""
    per_pair = received.groupBy(*PAIR).agg(F.sum("quantity_ordered").alias("quantity_ordered"))
    arrived = F.col("new.quantity_ordered")
    return update_by_key(
        stock,
        per_pair,
        PAIR,
        {
            "quantity_on_hand": F.col("quantity_on_hand") + arrived,
            "quantity_on_order": F.greatest(F.lit(0), F.col("quantity_on_order") - arrived),
            "last_counted_at": now,
        },
    )


def place_orders(stock: DataFrame, orders: DataFrame, now: Column) -> DataFrame:
    """Stock after new orders: on order grows."""
    per_pair = orders.groupBy(*PAIR).agg(F.sum("quantity_ordered").alias("quantity_ordered"))
    return update_by_key(
        stock,
        per_pair,
        PAIR,
        {"quantity_on_order": F.col("quantity_on_order") + F.col("new.quantity_ordered"), "last_counted_at": now},
    )
