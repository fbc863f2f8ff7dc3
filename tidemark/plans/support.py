"""Support analytics: revenue by day, case context, overview, user profile, queue, decisions.

`as_of` is the day that stands for "today"; 90-day measures count from its date, except in
`case_queue`, whose callers pass an instant. All money is integer cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import money
from ..operators.context import top_lines
from ..operators.filters import thread_role
from ..operators.joins import pick_child, spine_join
from ..operators.windows import threads

RECENT_DAYS = 90


def _day(ts: str) -> Column:
    return F.to_date(ts)


def daily_revenue(
    orders: DataFrame, order_items: DataFrame, refunds: DataFrame, credits: DataFrame, menu_items: DataFrame
) -> DataFrame:
    """Revenue per day that has orders.

    Refunds count when approved and fall on the day of their order; credits on their own day.
    """
    dated = orders.select(F.col("id").alias("order_id"), _day("created_at").alias("order_date"), "total_in_cents")
    totals = dated.groupBy("order_date").agg(
        F.countDistinct("order_id").alias("total_orders"), F.sum("total_in_cents").alias("gross_revenue_cents")
    )
    days = dated.select("order_id", "order_date")
    refunded = (
        refunds.where(F.col("status") == "approved")
        .groupBy("order_id")
        .agg(F.sum("amount_in_cents").alias("cents"))
        .join(days, "order_id")
        .groupBy("order_date")
        .agg(F.sum("cents").alias("total_refunds_cents"))
    )
    credited = credits.groupBy(_day("created_at").alias("order_date")).agg(
        F.sum("amount_in_cents").alias("total_credits_cents")
    )
    # One join of items to orders serves both the item count and the top category. An order with very
    # many items is a skewed partition that adaptive execution splits: the other side has one row.
    revenue = F.col("price_in_cents") * F.col("quantity")
    by_product = (
        order_items.select("order_id", "menu_item_id", "quantity", revenue.alias("revenue"))
        .join(days, "order_id")
        .groupBy("order_date", "menu_item_id")
        .agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))
    )
    by_category = (
        by_product.join(menu_items.select(F.col("id").alias("menu_item_id"), "category"), "menu_item_id", "left")
        .groupBy("order_date", "category")
        .agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))
    )
    sold = by_category.groupBy("order_date").agg(
        F.sum("quantity").alias("items_sold"),
        F.min_by("category", F.when(F.col("category").isNotNull(), F.struct(-F.col("revenue"), F.col("category")))).alias(
            "top_category"
        ),
    )
    fill = {"total_refunds_cents": 0, "total_credits_cents": 0, "items_sold": 0}
    joined = spine_join(totals, [sold, refunded, credited], ["order_date"], fill)
    net = F.col("gross_revenue_cents") - F.col("total_refunds_cents") - F.col("total_credits_cents")
    return joined.select(
        "order_date",
        "total_orders",
        "gross_revenue_cents",
        "total_refunds_cents",
        "total_credits_cents",
        net.alias("net_revenue_cents"),
        (F.col("gross_revenue_cents") / F.col("total_orders")).cast("long").alias("avg_order_value_cents"),
        "items_sold",
        "top_category",
    )


def message_stats(messages: DataFrame) -> DataFrame:
    """Per case: count, first and last message, any admin reply, first admin reply; one pass."""
    admin = F.col("admin_id").isNotNull()
    return messages.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min("created_at").alias("first_message_at"),
        F.max("created_at").alias("last_message_at"),
        F.bool_or(admin).alias("has_admin_reply"),
        F.min(F.when(admin, F.col("created_at"))).alias("first_reply_at"),
    )


def _linked(rows: DataFrame, alias: str) -> DataFrame:
    linked = rows.where(F.col("support_case_id").isNotNull())
    return linked.groupBy(F.col("support_case_id").alias("case_id")).agg(F.sum("amount_in_cents").alias(alias))


def _minutes(start: str, end: str) -> Column:
    return F.timestamp_diff("MINUTE", F.col(start), F.col(end)).cast("long")


def support_case_context(
    cases: DataFrame, users: DataFrame, messages: DataFrame, refunds: DataFrame, credits: DataFrame, orders: DataFrame, as_of: Column
) -> DataFrame:
    """One row per case with its user, messages, money and the user's history.

    The first response runs from case creation to the first admin message, whole minutes, NULL
    without a reply. Refunds and credits of any status count.
    """
    spine = cases.select(
        F.col("id").alias("case_id"), "user_id", "subject", "status", F.col("created_at").alias("case_created_at")
    )
    recent = F.col("case_created_at") >= F.date_sub(as_of, RECENT_DAYS)
    user_part = users.select(
        F.col("id").alias("user_id"),
        F.col("name").alias("user_name"),
        F.col("email").alias("user_email"),
        F.col("region").alias("user_region"),
    )
    spend = orders.groupBy("user_id").agg(F.sum("total_in_cents").alias("user_lifetime_spend_cents"))
    cases_90d = spine.where(recent).groupBy("user_id").agg(F.count(F.lit(1)).alias("user_cases_90d"))
    # Everything about a user is gathered per user, then meets the cases once.
    per_user = spine_join(
        user_part, [spend, cases_90d], ["user_id"], {"user_lifetime_spend_cents": 0, "user_cases_90d": 0}
    )
    parts = [message_stats(messages), _linked(refunds, "linked_refund_cents"), _linked(credits, "linked_credit_cents")]
    per_case = spine_join(
        spine, parts, ["case_id"], {"message_count": 0, "has_admin_reply": False, "linked_refund_cents": 0, "linked_credit_cents": 0}
    )
    return per_case.join(per_user, "user_id").select(
        "case_id",
        "user_id",
        "user_name",
        "user_email",
        "user_region",
        "subject",
        "status",
        "case_created_at",
        "message_count",
        "first_message_at",
        "last_message_at",
        "has_admin_reply",
        _minutes("case_created_at", "first_reply_at").alias("first_response_minutes"),
        "linked_refund_cents",
        "linked_credit_cents",
        "user_lifetime_spend_cents",
        "user_cases_90d",
    )


def support_overview(cases: DataFrame, messages: DataFrame, refunds: DataFrame, credits: DataFrame) -> DataFrame:
    """Per case date: volumes, averages over the cases that have messages or replies, linked money.

    Every fact is reduced to its case first and the day totals come from one grouped pass.
    """
    stats = message_stats(messages).select("case_id", "message_count", "first_reply_at")
    parts = [stats, _linked(refunds, "refund_cents"), _linked(credits, "credit_cents")]
    # A case with a linked row whose amount is NULL still has a refund or credit.
    flagged = [parts[0]] + [p.withColumn(f"has_{k}", F.lit(1)) for p, k in zip(parts[1:], ("refund", "credit"))]
    per_case = spine_join(
        cases.select(F.col("id").alias("case_id"), "created_at", "status"), flagged, ["case_id"]
    )
    zero = F.lit(0)
    return per_case.groupBy(_day("created_at").alias("case_date")).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("status") == "open").alias("open_cases"),
        F.count_if(F.col("status") == "resolved").alias("resolved_cases"),
        F.coalesce(F.avg("message_count"), F.lit(0.0)).alias("avg_messages_per_case"),
        F.coalesce(F.avg(_minutes("created_at", "first_reply_at")), F.lit(0.0)).alias("avg_first_response_minutes"),
        F.count("has_refund").alias("cases_with_refund"),
        F.count("has_credit").alias("cases_with_credit"),
        F.coalesce(F.sum("refund_cents"), zero).alias("total_refund_cents"),
        F.coalesce(F.sum("credit_cents"), zero).alias("total_credit_cents"),
    )


def user_support_profile(
    users: DataFrame, orders: DataFrame, cases: DataFrame, refunds: DataFrame, credits: DataFrame, as_of: Column
) -> DataFrame:
    """Lifetime and 90-day measures; every user is kept."""
    recent = F.col("created_at") >= F.date_sub(as_of, RECENT_DAYS)

    def recent_sum(amount: str) -> Column:
        return F.sum(F.when(recent, F.col(amount)).otherwise(0))

    parts = [
        orders.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("lifetime_order_count"),
            F.sum("total_in_cents").alias("lifetime_spend_cents"),
            F.max("created_at").alias("last_order_date"),
            F.count_if(recent).alias("total_orders_90d"),
            recent_sum("total_in_cents").alias("total_spend_90d_cents"),
        ),
        cases.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("support_cases_lifetime"),
            F.max("created_at").alias("last_support_case_date"),
            F.count_if(recent).alias("support_cases_90d"),
        ),
        refunds.groupBy("user_id").agg(recent_sum("amount_in_cents").alias("total_refunds_90d_cents")),
        credits.groupBy("user_id").agg(recent_sum("amount_in_cents").alias("total_credits_90d_cents")),
    ]
    counts = [
        "total_orders_90d",
        "total_spend_90d_cents",
        "lifetime_order_count",
        "lifetime_spend_cents",
        "support_cases_90d",
        "support_cases_lifetime",
        "total_refunds_90d_cents",
        "total_credits_90d_cents",
    ]
    spine = users.select(F.col("id").alias("user_id"), "name", "email", "region")
    joined = spine_join(spine, parts, ["user_id"], {c: 0 for c in counts})
    return joined.select("user_id", "name", "email", "region", *counts, "last_order_date", "last_support_case_date")


def case_queue(cases: DataFrame, users: DataFrame, messages: DataFrame, responses: DataFrame) -> DataFrame:
    """Cases with message facts and the newest suggestion.

    Here the first response runs from the case's first message to its first admin message, rounded
    to the nearest minute.
    """
    span = F.unix_micros(F.col("first_reply_at").cast("timestamp")) - F.unix_micros(F.col("first_message_at").cast("timestamp"))
    stats = message_stats(messages).select(
        "case_id", "message_count", "has_admin_reply", F.bround(span / 6e7, 0).cast("int").alias("first_response_minutes")
    )
    spine = cases.select(
        F.col("id").alias("case_id"), "user_id", "subject", "status", F.col("created_at").alias("case_created_at")
    )
    people = users.select(
        F.col("id").alias("user_id"), F.col("name").alias("user_name"), F.col("email").alias("user_email")
    )
    with_stats = spine_join(spine, [stats], ["case_id"], {"message_count": 0, "has_admin_reply": False})
    columns = ["suggested_action", "suggested_amount_cents", "case_summary"]
    with_reply = pick_child(with_stats, responses, ["case_id"], ["generated_at", "message_id"], columns)
    return with_reply.join(people, "user_id").select(
        "case_id",
        "user_id",
        "user_name",
        "user_email",
        "subject",
        "status",
        "case_created_at",
        "message_count",
        "has_admin_reply",
        "first_response_minutes",
        *columns,
    )


def action_performance(responses: DataFrame) -> DataFrame:
    """Suggestions and average amount per action."""
    return responses.groupBy(F.col("suggested_action").alias("action")).agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("suggested_amount_cents"), 0).alias("avg_amount_cents")
    )


def metrics_view(overview: DataFrame) -> DataFrame:
    """The overview with its averages rounded for display."""
    return overview.withColumns(
        {
            "avg_messages_per_case": F.round("avg_messages_per_case", 1),
            "avg_first_response_minutes": F.round("avg_first_response_minutes", 0),
        }
    )


def case_prompts(
    queue: DataFrame, context: DataFrame, profile: DataFrame, orders: DataFrame, messages: DataFrame, page_rows: int = 10_000
) -> DataFrame:
    """Text for a model per waiting case: facts, profile, five newest orders, the message thread.

    All cases at once, as joins. A thread beyond `page_rows` messages continues on further pages.
    """
    facts = queue.join(
        context.select(
            "case_id", "user_name", "user_email", "user_region", "message_count", "has_admin_reply",
            "first_response_minutes", "linked_refund_cents", "linked_credit_cents",
        ),
        "case_id",
        "left",
    )
    known = F.col("user_name").isNotNull()
    answered = F.when(F.col("has_admin_reply"), "True").otherwise("False")
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Subject: "), F.col("subject")),
        F.concat(F.lit("Status: "), F.col("status")),
        F.when(known, F.format_string("Customer: %s (%s), region: %s", "user_name", "user_email", "user_region")),
        F.when(known, F.format_string("Messages so far: %d", "message_count")),
        F.when(known, F.concat(F.lit("Admin has replied: "), answered)),
        F.when(
            F.col("first_response_minutes").isNotNull(),
            F.format_string("First response time: %d minutes", "first_response_minutes"),
        ),
        F.when(known, F.concat(F.lit("Linked refunds: "), money(F.col("linked_refund_cents")))),
        F.when(known, F.concat(F.lit("Linked credits: "), money(F.col("linked_credit_cents")))),
    )
    about = F.concat_ws(
        "\n",
        F.lit("\nCustomer Profile:"),
        F.format_string("  Lifetime orders: %d, spend: $%.2f", "lifetime_order_count", F.col("lifetime_spend_cents") / 100.0),
        F.format_string("  Last 90 days: %d orders, $%.2f spent", "total_orders_90d", F.col("total_spend_90d_cents") / 100.0),
        F.format_string("  Support cases (90d): %d", "support_cases_90d"),
        F.format_string("  Refunds (90d): $%.2f", F.col("total_refunds_90d_cents") / 100.0),
        F.format_string("  Credits (90d): $%.2f", F.col("total_credits_90d_cents") / 100.0),
    )
    about = profile.select("user_id", about.alias("about"))
    line = F.format_string(
        "  [%s] $%.2f — %s", F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.col("total_in_cents") / 100.0, F.col("status")
    )
    wanted = orders.join(queue.select("user_id").distinct(), "user_id", "left_semi")
    recent = top_lines(wanted, ["user_id"], ["created_at", "id"], line, 5, "orders", newest=True)
    newest = wanted.groupBy("user_id").agg(
        F.max_by(money(F.col("total_in_cents")), F.struct("created_at", "id")).alias("newest_total")
    )
    listed = F.concat_ws(
        "\n",
        F.lit("\nRecent Orders (newest first):"),
        F.array_join("orders", "\n"),
        F.concat(F.lit("  Most recent order total: "), F.col("newest_total")),
    )
    listed = F.when(F.col("orders").isNotNull(), listed).otherwise("\nNo recent orders found.")
    said = F.format_string(
        "  [%s] %s: %s", F.date_format("created_at", "HH:mm"), F.upper(thread_role()), F.coalesce("content", F.lit(""))
    )
    asked = messages.join(queue.select("case_id"), "case_id", "left_semi")
    thread = threads(asked, ["case_id"], ["created_at", "id"], said, "thread", page_rows=page_rows)
    opening = (
        facts.join(about, "user_id", "left")
        .join(recent, "user_id", "left")
        .join(newest, "user_id", "left")
        .select("case_id", F.concat_ws("\n", head, F.col("about"), listed, F.lit("\nMessage Thread:")).alias("opening"))
    )
    pages = opening.join(thread, "case_id", "left").withColumn("page", F.coalesce("page", F.lit(0)))
    text = F.when(F.col("page") == 0, F.concat_ws("\n", "opening", "thread")).otherwise(F.col("thread"))
    return pages.select("case_id", "page", text.alias("prompt"))


def decision_outputs(decisions: DataFrame, cases: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    """What a batch of admin decisions writes: messages, refunds, credits, and the cases' new status.

    `decisions`: id, case_id, admin_id, action, amount_cents, response, decided_at. A refund goes to
    the user's newest order and is capped by its total. The outputs carry decision_id; written with
    `insert_new` on it, a rerun changes nothing. There is no transaction across the tables.
    """
    owned = decisions.withColumnRenamed("id", "decision_id").join(
        cases.select(F.col("id").alias("case_id"), "user_id", F.col("status").alias("case_status")), "case_id"
    )
    by_admin = owned.where(F.col("admin_id").isNotNull())
    latest = orders.groupBy("user_id").agg(
        F.max_by(F.struct(F.col("id").alias("order_id"), "total_in_cents"), F.struct("created_at", "id")).alias("o")
    )
    paid = owned.where(F.col("amount_cents") > 0)
    refunds = (
        paid.where(F.col("action") == "refund")
        .join(latest, "user_id")
        .select(
            "decision_id",
            "user_id",
            "o.order_id",
            F.col("case_id").alias("support_case_id"),
            F.least("amount_cents", "o.total_in_cents").alias("amount_in_cents"),
            F.col("response").alias("reason"),
        )
    )
    credits = paid.where(F.col("action") == "credit").select(
        "decision_id",
        "user_id",
        F.col("case_id").alias("support_case_id"),
        F.col("amount_cents").alias("amount_in_cents"),
        F.col("response").alias("reason"),
    )
    # Decisions of one case apply in order: any 'resolve' settles it, otherwise an open case moves on.
    status = by_admin.groupBy("case_id").agg(
        F.first("case_status").alias("old"),
        F.bool_or(F.col("action") == "resolve").alias("resolved"),
        F.max("decided_at").alias("updated_at"),
    )
    new = F.when(F.col("resolved"), "resolved").when(F.col("old") == "open", "in_progress").otherwise(F.col("old"))
    return {
        "messages": by_admin.select("decision_id", "case_id", "admin_id", F.col("response").alias("content"), "decided_at"),
        "refunds": refunds,
        "credits": credits,
        "case_status": status.select(F.col("case_id").alias("id"), new.alias("status"), "updated_at"),
    }
