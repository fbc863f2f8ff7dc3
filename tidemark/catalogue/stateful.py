"""Results that rest on something kept between runs: indexes, sketches, saved detection state, versions and commit records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import additive, retrieval, sketches, trigrams, vector_index
from ..plans import monitoring, monitoring_resume, support
from ..session import scratch_path, staged
from ..sources import commits, published, sealed
from .domains import SQL_ALERTS, SQL_HISTORY, type_history
from .registry import Entry, Tables


def _queries(t: Tables) -> DataFrame:
    """Every twentieth vector asks for its neighbours among all."""
    return t.embeddings.where("vec_id % 20 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _index(t: Tables) -> vector_index.VectorIndex:
    return vector_index.build(t.embeddings, "vec_id", "embedding", scratch_path(t.spark, "vectors"))


SQL_SIMILAR = """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM {embeddings} WHERE vec_id % 20 = 0 AND embedding IS NOT NULL)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS score FROM {embeddings}, q)
    QUALIFY rank <= 5"""


def index_recall(t: Tables) -> DataFrame:
    """Whether tuned probing finds 95 in 100 of the neighbours that the scan of all vectors finds; tuned on up to 50 queries."""
    index = _index(t)
    some = [(r.query_id, list(r.vector)) for r in _queries(t).orderBy(F.xxhash64("query_id")).limit(50).collect()]
    found = vector_index.search(index, _queries(t), 5, probes=vector_index.tuned_probes(index, some, 5, 0.97))
    exact = retrieval.top_k_similar(t.embeddings, "vec_id", "embedding", _queries(t), 5)
    return vector_index.recall(found.rows, exact, "vec_id").select("pairs", (F.col("recall") >= 0.95).alias("enough"))


def resumed_hits(t: Tables) -> dict:
    """The rules over the first half of the time and then, from the saved state alone, over the second."""
    rules = {r.rule_id: r for r in monitoring_resume.standard_rules(low=100_000, high=1_500_000, wire=200_000, listed=500_000, gap="180 days", wake_span="30 days", woken=30_000_000, round_minimum=100_000, unit=1_000, round_count=2, round_span="10 days")}
    detector = monitoring_resume.Detector(t.spark, scratch_path(t.spark, "detector"), list(rules.values()))
    orders = t.m_order_txns.select("customer_id", "txn_id", "ts", "type", "amount_cents", "counterparty_country")
    txns = t.m_txns.select(*orders.columns)

    def half(rows: DataFrame, late: bool) -> DataFrame:
        middle = rows.agg(F.timestamp_micros(F.floor((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2)).cast("timestamp_ntz").alias("m")).scalar()
        return rows.where(F.col("ts") >= middle if late else F.col("ts") < middle)

    for run, late in enumerate((False, True)):
        detector.advance(run, {r: half(orders if r == "DORMANT_REACTIVATION" else txns, late) for r in rules})
    return detector.hits(1)


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


def _older(t: Tables) -> DataFrame:
    """An earlier version: without the rows of one status, some prices lower, and rows that are gone now."""
    rows = _orders(t).where("o_orderstatus <> 'P'").withColumn("cents", F.when(F.col("o_orderkey") % 5 == 0, F.col("cents") - 1).otherwise(F.col("cents")))
    gone = t.customer.select((F.col("c_custkey") + 1_000_000_000).alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit(0).cast("long").alias("cents"))
    return rows.unionByName(gone)


def _published(t: Tables):
    old = _older(t)
    copy = published.PublishedCopy(t.spark, scratch_path(t.spark, "published"), old.schema, ["o_orderkey"])
    copy.publish(old)
    return copy, copy.publish(_orders(t))


DECISION_TABLES = {
    "messages": "decision_id string, case_id long, admin_id long, content string, decided_at timestamp_ntz",
    "refunds": "decision_id string, user_id long, order_id long, support_case_id long, amount_in_cents long, reason string",
    "credits": "decision_id string, user_id long, support_case_id long, amount_in_cents long, reason string",
    "case_status": "id long, status string, updated_at timestamp_ntz",
}


def committed(t: Tables, name: str) -> DataFrame:
    """A table of decision outputs after one batch broke off between two tables and was written again, another twice."""
    found = support.decision_outputs(t.s_decisions, t.s_cases, t.s_orders)
    store = commits.CommittedTables(t.spark, scratch_path(t.spark, "decisions"), DECISION_TABLES)
    batch = staged(found[name], "outputs")
    outputs = {n: batch if n == name else t.spark.createDataFrame([], ddl) for n, ddl in DECISION_TABLES.items()}
    store._put(name, "first", "broken", batch.withColumns({c: F.lit(None).cast(batch.schema[c].dataType) for c in batch.columns}))
    for _ in range(2):
        store.write("first", outputs)
    return store.read(name)


def merged_distinct(t: Tables) -> DataFrame:
    """Customers per quarter, and whether the union of daily sketches is within three standard errors of that."""
    names = {"customers": "o_custkey"}
    daily = staged(sketches.distinct_sketches(t.orders, [F.to_date("o_orderdate").alias("day")], names), "sketches")
    quarter = F.trunc("day", "quarter").alias("quarter")
    merged = sketches.estimates(sketches.merge_sketches(daily, [quarter], ["customers"]), ["customers"]).withColumnRenamed("customers", "guess")
    exact = sketches.distinct_counts(t.orders, [F.trunc(F.to_date("o_orderdate"), "quarter").alias("quarter")], names)
    off = F.abs(F.col("guess") - F.col("customers")) <= 3 * sketches.relative_error() * F.col("customers") + 1
    return exact.join(merged, "quarter").select("quarter", "customers", off.alias("within"))


def sealed_orders(t: Tables) -> DataFrame:
    """Orders appended to a sealed log in three steps, each after a check of what is there."""
    log = sealed.SealedLog(t.spark, scratch_path(t.spark, "sealed"), "o_orderkey long, o_orderstatus string, cents long")
    for state in ("O", "F", "P"):
        log.append(_orders(t).where(F.col("o_orderstatus") == state))
    log.check()
    return log.read()


def trigram_search(t: Tables) -> DataFrame:
    """A search that reads the parts whose trigrams allow the text."""
    path, columns = scratch_path(t.spark, "trigrams"), ["p_name", "p_type"]
    trigrams.build(t.part, columns, path, parts=16)
    return trigrams.search(t.spark, path, columns, " Eco", {"p_size": [], "p_brand": ["Brand#2", "Brand#4"]}).rows


SQL_DECISIONS = {
    "messages": "SELECT d.id AS decision_id, d.case_id, d.admin_id, d.response AS content, d.decided_at FROM {s_decisions} d JOIN {s_cases} c ON c.id = d.case_id WHERE admin_id IS NOT NULL",
    "credits": """SELECT d.id AS decision_id, c.user_id, d.case_id AS support_case_id, d.amount_cents AS amount_in_cents, d.response AS reason
        FROM {s_decisions} d JOIN {s_cases} c ON c.id = d.case_id WHERE d.action = 'credit' AND d.amount_cents > 0""",
    "refunds": """SELECT d.id AS decision_id, c.user_id, o.id AS order_id, d.case_id AS support_case_id,
        least(d.amount_cents, o.total_in_cents) AS amount_in_cents, d.response AS reason FROM {s_decisions} d JOIN {s_cases} c ON c.id = d.case_id
        JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM {s_orders}) o
          ON o.user_id = c.user_id AND o.rn = 1 WHERE d.action = 'refund' AND d.amount_cents > 0""",
    "case_status": """SELECT c.id, CASE WHEN count(*) FILTER (d.action = 'resolve') > 0 THEN 'resolved' WHEN c.status = 'open' THEN 'in_progress'
        ELSE c.status END AS status, max(d.decided_at) AS updated_at FROM {s_decisions} d JOIN {s_cases} c ON c.id = d.case_id
        WHERE d.admin_id IS NOT NULL GROUP BY c.id, c.status""",
}
COMMITTED_COLUMNS = {
    "messages": "decision_id:s case_id:b admin_id:b content:s decided_at:t",
    "credits": "decision_id:s user_id:b support_case_id:b amount_in_cents:b reason:s",
    "refunds": "decision_id:s user_id:b order_id:b support_case_id:b amount_in_cents:b reason:s",
    "case_status": "id:b status:s updated_at:t",
}
SQL_ORDERS = "SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM {orders}"
# the trend alone has a closed form: a line through the days of a key, summed over the next 30 where it is positive
SQL_TREND = f"""WITH h AS (SELECT region AS store_id, category AS product_id, sale_date, sum(units_sold) AS units FROM ({SQL_HISTORY}) x
      JOIN {{i_stores}} s ON s.id = x.store_id JOIN {{i_products}} p ON p.id = x.product_id GROUP BY ALL),
    f AS (SELECT store_id, product_id, regr_slope(units, day) AS slope, regr_intercept(units, day) AS level, max(day) AS length, avg(units) AS mean, count(*) AS days
      FROM (SELECT *, sale_date - min(sale_date) OVER (PARTITION BY store_id, product_id) AS day FROM h) GROUP BY ALL)
    SELECT store_id, product_id, CASE WHEN length = 0 THEN mean * 30 ELSE list_sum(list_transform(range(1, 31), lambda i: greatest(0, level + slope * (length + i)))) END
      AS forecast_30d_units, CASE WHEN days >= 60 THEN 'high' WHEN days >= 30 THEN 'medium' ELSE 'low' END AS confidence FROM f"""
FORECAST = "store_id:s product_id:s forecast_30d_units:d1 confidence:s"

ENTRIES = [
    Entry("indexed_similar", "query_id:b vec_id:b score:d6 rank:b", lambda t: vector_index.search(_index(t), _queries(t), 5, probes=4, exact=True).rows, SQL_SIMILAR),
    Entry(
        "index_recall",
        "pairs:b enough:B",
        index_recall,
        "SELECT 5 * count(*) AS pairs, true AS enough FROM {embeddings} WHERE vec_id % 20 = 0 AND embedding IS NOT NULL",
    ),
    Entry("additive_forecast", FORECAST, lambda t: additive.forecast_additive(type_history(t))),
    Entry("trend_forecast", FORECAST, lambda t: additive.forecast_additive(type_history(t), bends=0, order=0), SQL_TREND),
    Entry(
        "resumed_alerts",
        "alert_id:s rule_id:s rule_version:b customer_id:b score:b n_evidence:b total_amount:d2 first_ts:t last_ts:t created_at:t",
        lambda t: monitoring.score_alerts(resumed_hits(t), t.m_customers),
        SQL_ALERTS,
    ),
    Entry("published_copy", "o_orderkey:b o_orderstatus:s cents:b", lambda t: _published(t)[0].current(), SQL_ORDERS),
    Entry(
        "published_changes",
        "operation:s n:b",
        lambda t: _published(t)[1].groupBy("operation").agg(F.count(F.lit(1)).alias("n")),
        """SELECT CASE WHEN o_orderstatus = 'P' THEN 'insert' ELSE 'update' END AS operation, count(*) AS n FROM {orders}
        WHERE o_orderstatus = 'P' OR o_orderkey % 5 = 0 GROUP BY 1 UNION ALL SELECT 'delete', count(*) FROM {customer}""",
    ),
    *(Entry(f"committed_{n}", c, lambda t, n=n: committed(t, n), SQL_DECISIONS[n]) for n, c in COMMITTED_COLUMNS.items()),
    Entry(
        "merged_distinct",
        "quarter:D customers:b within:B",
        merged_distinct,
        "SELECT date_trunc('quarter', o_orderdate) AS quarter, count(DISTINCT o_custkey) AS customers, true AS within FROM {orders} GROUP BY 1",
    ),
    Entry("sealed_orders", "o_orderkey:b o_orderstatus:s cents:b", sealed_orders, SQL_ORDERS),
    Entry(
        "trigram_search",
        "p_partkey:b p_name:s p_type:s p_brand:s",
        trigram_search,
        "SELECT * FROM {part} WHERE (p_name ILIKE '%eco%' OR p_type ILIKE '%eco%') AND p_brand IN ('Brand#2', 'Brand#4')",
    ),
]
