"""Retail operations, return eligibility, and the customer-service lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.aggregates import share_pct
from ..operators.hotkeys import dealt, hot_keys
from ..operators.joins import flag_exists, spine_join
from ..operators.text import first_problem
from ..operators.windows import paged_lists

# Return windows in days by tier, and the reason texts.
RETURN_WINDOW_DAYS = {"GOLD": 60}
DEFAULT_RETURN_WINDOW_DAYS = 30
NOT_DELIVERED = "Order is %s, not delivered yet."
ALREADY_REQUESTED = "A return was already requested for this order."
FINAL_SALE = "All items in this order are final sale."
WINDOW_ENDED = "The %d-day return window ended on %s."
RETURNABLE = "Returnable until %s (%d-day window).%s"
EXCLUSION_NOTE = " Final-sale items in the order are excluded."


def retail_kpis(orders: DataFrame, returns: DataFrame, today: Column) -> DataFrame:
    """One row: orders and revenue of 30 days, open returns, return rate of delivered orders."""
    recent = F.col("order_date") >= F.date_sub(today, 30)
    back = returns.agg(
        F.count_if(F.col("status") == "REQUESTED").alias("open_returns"), F.countDistinct("order_id").alias("returned")
    )
    open_returns = back.select("open_returns").scalar()
    returned = back.select("returned").scalar()
    sums = orders.agg(
        F.count_if(recent).alias("orders_30d"),
        F.round(F.sum(F.when(recent, F.col("total"))), 2).alias("revenue_30d"),
        F.count_if(F.col("status") == "DELIVERED").alias("delivered"),
    )
    return sums.select(
        "orders_30d", "revenue_30d", open_returns.alias("open_returns"), share_pct(returned, F.col("delivered")).alias("return_rate_pct")
    )


def return_rate_by_category(order_items: DataFrame, products: DataFrame, orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Share of delivered orders with a return; an order counts once in each of its categories."""
    listed = order_items.select("order_id", "product_id").distinct()
    pairs = listed.join(products.select("product_id", "category"), "product_id").select("order_id", "category").distinct()
    delivered = orders.where(F.col("status") == "DELIVERED").select("order_id")
    flagged = flag_exists(delivered, returns, ["order_id"], "returned")
    return (
        pairs.join(flagged, "order_id")
        .groupBy("category")
        .agg(share_pct(F.count_if("returned"), F.count(F.lit(1))).alias("return_rate_pct"))
    )


def late_deliveries(orders: DataFrame, days: int = 7) -> DataFrame:
    """Orders delivered more than `days` after they were placed."""
    took = F.datediff("delivered_date", "order_date")
    return orders.where(took > days).select("order_id", "order_date", "delivered_date", took.alias("days"))


def open_returns(returns: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Requested returns with the customer's address."""
    asked = returns.where(F.col("status") == "REQUESTED").select("return_id", "order_id", "reason", "requested_at")
    owners = orders.select("order_id", "customer_id")
    return asked.join(owners, "order_id").join(customers.select("customer_id", "email"), "customer_id").drop("customer_id")


def newest(df: DataFrame, ts: str, key: str, n: int = 50) -> DataFrame:
    """The newest n rows of a report."""
    return df.orderBy(F.col(ts).desc(), key).limit(int(n))


def return_eligibility(
    orders: DataFrame, order_items: DataFrame, products: DataFrame, returns: DataFrame, customers: DataFrame, today: Column
) -> DataFrame:
    """Per order: may it be returned today, until when, and why (not)."""
    sellable = products.select("product_id", F.col("returnable").cast("boolean").alias("returnable"))
    # Items collapse per order and product before products are joined.
    lines = order_items.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    counts = lines.join(sellable, "product_id").groupBy("order_id").agg(
        F.sum("n").alias("items"), F.sum(F.when(F.col("returnable"), F.col("n")).otherwise(0)).alias("returnable_items")
    )
    window = F.lit(DEFAULT_RETURN_WINDOW_DAYS)
    for tier, days in RETURN_WINDOW_DAYS.items():
        window = F.when(F.col("loyalty_tier") == tier, days).otherwise(window)
    rows = spine_join(
        orders.select("order_id", "customer_id", "status", "delivered_date"), [counts], ["order_id"], {"items": 0, "returnable_items": 0}
    )
    rows = flag_exists(rows, returns, ["order_id"], "has_return")
    rows = rows.join(customers.select("customer_id", "loyalty_tier"), "customer_id")
    rows = rows.withColumn("window_days", window).withColumn("deadline", F.expr("date_add(delivered_date, window_days)"))
    deadline = F.col("deadline").cast("string")
    problem = first_problem(
        [
            (
                F.coalesce(F.col("status") != "DELIVERED", F.lit(True)) | F.col("delivered_date").isNull(),
                F.format_string(NOT_DELIVERED, F.lower("status")),
            ),
            (F.col("has_return"), F.lit(ALREADY_REQUESTED)),
            (F.col("returnable_items") == 0, F.lit(FINAL_SALE)),
            (today > F.col("deadline"), F.format_string(WINDOW_ENDED, F.col("window_days"), deadline)),
        ]
    )
    note = F.when(F.col("returnable_items") == F.col("items"), "").otherwise(EXCLUSION_NOTE)
    granted = F.format_string(RETURNABLE, deadline, F.col("window_days"), note)
    return rows.withColumn("problem", problem).select(
        "order_id",
        F.col("problem").isNull().alias("eligible"),
        F.when(F.col("problem").isNull(), F.col("deadline")).alias("deadline"),
        F.coalesce("problem", granted).alias("reason"),
    )


def find_customer(customers: DataFrame, email: str) -> DataFrame:
    """The customer with this address, any case."""
    return customers.where(F.lower("email") == email.strip().lower())


def recent_orders(orders: DataFrame, customer_id, n: int = 5) -> DataFrame:
    """A customer's newest orders, at most 20."""
    mine = orders.where(F.col("customer_id") == customer_id)
    return mine.orderBy(F.col("order_date").desc(), "order_id").limit(int(min(n, 20)))


def item_pages(order_items: DataFrame, products: DataFrame, page_size: int = 10_000) -> DataFrame:
    """Items of every order as nested arrays: order_id, page, items.

    Equal lines are listed once with their number. An order with more than `page_size` different
    lines continues on further pages; others have page 0 only. Products of one name, category and kind are one item.
    """
    item, rows = ["name", "category", "returnable", "quantity", "unit_price"], order_items.count()
    crowded, popular = hot_keys(order_items, ["order_id"]), hot_keys(order_items, ["product_id"])
    sold = order_items.select("order_id", "product_id", "quantity", "unit_price")
    named = (sold if popular else dealt(sold, ["product_id"], rows)).join(products.select("product_id", "name", "category", "returnable"), "product_id")
    # by order alone, what follows moves no row again; crowded orders are spread
    lines = dealt(named, ["order_id", *item] if crowded else ["order_id"], rows).groupBy("order_id", *item).agg(F.count(F.lit(1)).alias("lines"))
    return paged_lists(lines.select("order_id", F.struct(*item, "lines").alias("item")), ["order_id"], "item", "items", page_size, crowded)


def order_details(
    orders: DataFrame, customers: DataFrame, order_items: DataFrame, products: DataFrame, returns: DataFrame, order_id
) -> DataFrame:
    """One order with tier and e-mail, beside the pages of its items and its returns."""
    wanted = F.col("order_id") == (order_id.strip().upper() if isinstance(order_id, str) else order_id)
    back = returns.where(wanted).select("order_id", F.struct("return_id", "reason", "status", "requested_at").alias("r"))
    return (
        orders.where(wanted)
        .join(customers.select("customer_id", "loyalty_tier", "email"), "customer_id")
        .join(item_pages(order_items.where(wanted), products), "order_id", "left")
        .join(paged_lists(back, ["order_id"], "r", "returns").withColumnRenamed("page", "returns_page"), "order_id", "left")
    )


def search_products(products: DataFrame, text: str, max_price: float | None = None, n: int = 10) -> DataFrame:
    """The n cheapest products whose name or category contains the text."""
    needle = text.strip().lower()
    hit = F.lower("name").contains(needle) | F.lower("category").contains(needle)
    rows = products.where(hit)
    if max_price is not None:
        rows = rows.where(F.col("price") <= float(max_price))
    return rows.orderBy("price", "product_id").limit(n)


def policy_text(policies: DataFrame, topic: str) -> DataFrame:
    """The policy of a topic, or a line saying there is none; always one row."""
    found = policies.where(F.col("topic") == topic).agg(F.min("content").alias("content"))
    return found.select(strip(F.coalesce("content", F.lit(f"No policy found for {topic!r}."))).alias("content"))
