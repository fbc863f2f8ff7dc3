"""Domain tables derived from the driver's tables, as SQL both engines read.

Each view projects whole tables onto the columns of a domain, so work grows with the data.
"""

from __future__ import annotations

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

LINE_ID = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"
K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
EMAIL = "concat(lower(replace(c_name, '#', '.')), '@example.com')"

VIEWS = {
    # support
    "s_users": f"SELECT c_custkey AS id, c_name AS name, {EMAIL} AS email, c_mktsegment AS region FROM {{customer}}",
    "s_orders": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS status,
        CAST(round(o_totalprice * 100) AS BIGINT) AS total_in_cents, o_orderdate AS created_at FROM {orders}""",
    "s_items": """SELECT l_orderkey AS order_id, l_partkey AS menu_item_id, CAST(l_quantity AS BIGINT) AS quantity,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS price_in_cents FROM {lineitem}""",
    "s_menu": "SELECT p_partkey AS id, p_name AS name, p_type AS category FROM {part}",
    "s_refunds": """SELECT l_suppkey AS user_id, l_orderkey AS order_id,
        CASE WHEN l_linestatus = 'O' THEN l_orderkey END AS support_case_id,
        CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) AS amount_in_cents,
        CASE WHEN l_linestatus = 'F' THEN 'approved' ELSE 'pending' END AS status, l_shipdate AS created_at
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    "s_credits": """SELECT l_suppkey AS user_id, CASE WHEN l_discount > 0.05 THEN l_orderkey END AS support_case_id,
        CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS amount_in_cents, l_shipdate AS created_at FROM {lineitem}""",
    "s_cases": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS subject,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'in_progress' END AS status,
        o_orderdate AS created_at FROM {orders}""",
    "s_messages": f"""SELECT {LINE_ID} AS id, l_orderkey AS case_id, CASE WHEN l_returnflag = 'A' THEN l_suppkey END AS admin_id,
        concat('about part ', l_partkey) AS content, l_shipdate AS created_at FROM {{lineitem}}""",
    "s_responses": f"""SELECT {LINE_ID} AS message_id, l_orderkey AS case_id,
        CASE l_linenumber WHEN 1 THEN 'refund' WHEN 2 THEN 'credit' WHEN 3 THEN 'no_action' WHEN 4 THEN 'escalate' ELSE 'resolve' END
        AS suggested_action, CAST(round(l_extendedprice * 100) AS BIGINT) AS suggested_amount_cents,
        concat('summary ', l_linenumber) AS case_summary, l_shipdate AS generated_at FROM {{lineitem}} WHERE l_returnflag = 'N'""",
    "s_decisions": f"""SELECT {LINE_ID} AS id, l_orderkey AS case_id, CASE WHEN l_linestatus = 'F' THEN l_suppkey END AS admin_id,
        CASE l_linenumber WHEN 1 THEN 'refund' WHEN 2 THEN 'credit' WHEN 3 THEN 'resolve' ELSE 'escalate' END AS action,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents, concat('reply ', l_partkey) AS response,
        l_shipdate AS decided_at FROM {{lineitem}} WHERE l_returnflag = 'A'""",
    # inventory
    "i_stores": """SELECT s_suppkey AS id, s_name AS name, r_name AS region, n_name AS city FROM {supplier}
        JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey""",
    "i_products": """SELECT p_partkey AS id, p_brand AS sku, p_name AS name, p_type AS category,
        CAST(round(p_retailprice * 100) AS BIGINT) AS unit_cost_cents, CAST(p_size AS BIGINT) AS reorder_point,
        CAST(p_size + 10 AS BIGINT) AS reorder_quantity, CAST(p_size AS BIGINT) AS lead_time_days FROM {part}""",
    "i_changes": f"""SELECT {LINE_ID} AS id, l_suppkey AS store_id, l_partkey AS product_id,
        CAST(l_quantity AS BIGINT) AS quantity_sold, CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit_price_cents,
        l_shipdate AS sold_at, CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'update' ELSE 'insert' END AS _pg_change_type,
        l_linenumber AS _pg_lsn FROM {{lineitem}}""",
    "i_stock": """SELECT l_suppkey AS store_id, l_partkey AS product_id, CAST(sum(l_linenumber) - 3 AS BIGINT) AS quantity_on_hand,
        CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END) AS BIGINT) AS quantity_on_order,
        max(l_shipdate) AS last_counted_at FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "i_recommendations": """SELECT l_suppkey AS store_id, l_partkey AS product_id, sum(l_quantity) AS forecast_30d_units,
        CASE max(l_returnflag) WHEN 'R' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence,
        CAST(sum(l_linenumber) - 2 AS BIGINT) AS recommended_order_qty, 'weighted_moving_average' AS model_used
        FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "i_orders": f"""SELECT {LINE_ID} AS id, l_suppkey AS store_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity_ordered,
        CASE l_linenumber WHEN 1 THEN 'pending' WHEN 2 THEN 'ordered' WHEN 3 THEN 'shipped' WHEN 4 THEN 'received' ELSE 'cancelled' END
        AS status, l_shipdate AS ordered_at, l_shipdate + INTERVAL 7 DAY AS expected_delivery_at FROM {{lineitem}}""",
    # transaction monitoring
    "m_txns": f"""SELECT event_id AS txn_id, user_id AS customer_id, ts, CASE event_type WHEN 'purchase' THEN 'CASH_DEPOSIT'
        WHEN 'click' THEN 'WIRE_IN' WHEN 'view' THEN 'WIRE_OUT' WHEN 'signup' THEN 'ACH_OUT' ELSE 'CARD' END AS type,
        CAST(round(value * 10000) AS BIGINT) AS amount_cents,
        CASE WHEN {K} < 10 THEN 'IR' WHEN {K} < 20 THEN 'SY' ELSE 'US' END AS counterparty_country, {K} AS counterparty FROM {{events}}""",
    "m_order_txns": """SELECT o_orderkey AS txn_id, o_custkey AS customer_id, o_orderdate AS ts, 'CARD' AS type,
        CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents, 'US' AS counterparty_country FROM {orders}""",
    "m_customers": """SELECT c_custkey AS customer_id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'HIGH'
        WHEN 'FURNITURE' THEN 'MEDIUM' ELSE 'LOW' END AS risk_rating, c_acctbal < 1000 AS pep,
        c_mktsegment AS segment, 'trader' AS occupation, DATE '2020-01-01' AS onboarded FROM {customer}""",
    "m_log": f"""SELECT event_id, concat('AL-STRUCTURING-', user_id) AS alert_id, CASE event_type WHEN 'error' THEN 'ESCALATE'
        WHEN 'click' THEN 'CLOSE_FALSE_POSITIVE' WHEN 'view' THEN 'APPROVE_SAR' WHEN 'signup' THEN 'RETURN' ELSE 'CLOSE_EXPLAINED' END
        AS action, CASE event_type WHEN 'error' THEN 'ESCALATED' WHEN 'click' THEN 'CLOSED_FALSE_POSITIVE' WHEN 'view' THEN 'SAR_APPROVED'
        WHEN 'signup' THEN 'RETURNED' ELSE 'CLOSED_EXPLAINED' END AS new_status,
        CASE WHEN {K} < 30 THEN 'kim' WHEN {K} < 60 THEN 'ruiz' WHEN {K} < 95 THEN 'osei' ELSE '' END AS actor,
        CASE WHEN value < 20 THEN '  too short  ' ELSE 'The pattern has no documented purpose.' END AS rationale,
        {K} < 50 AS ai_draft_used, ts AS decided_at FROM {{events}}""",
    "m_truth": "SELECT c_custkey AS customer_id, 'STRUCTURING' AS typology FROM {customer} WHERE c_mktsegment = 'BUILDING'",
    # city service
    "v_requests": """SELECT o.o_orderkey AS request_id, o.o_orderdate AS created_at,
        CASE WHEN s.shipped > o.o_orderdate THEN s.shipped END AS closed_at,
        CASE WHEN s.shipped > o.o_orderdate THEN 'CLOSED' ELSE 'OPEN' END AS status, o.o_orderpriority AS category,
        c.c_nationkey AS district_id, c.c_acctbal AS lat, o.o_totalprice AS lon FROM {orders} o
        JOIN {customer} c ON c.c_custkey = o.o_custkey
        LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped FROM {lineitem} GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey""",
    "v_categories": """SELECT DISTINCT o_orderpriority AS category, CASE WHEN o_orderpriority < '3' THEN 'Streets' ELSE 'Parks' END AS department,
        CAST(substr(o_orderpriority, 1, 1) AS INT) * 200 AS sla_days, 'HIGH' AS priority FROM {orders}""",
    "v_districts": "SELECT n_nationkey AS district_id, n_name AS name, n_nationkey * 1000 + 500 AS population FROM {nation}",
    # factory
    "f_readings": "SELECT user_id AS machine_id, ts, value AS vibration_rms, value / 2 + 20 AS temperature_c FROM {events}",
    "f_machines": """SELECT c_custkey AS machine_id, c_mktsegment AS line, CASE WHEN c_nationkey < 12 THEN 'CNC' ELSE 'PRESS' END AS machine_type,
        20 + c_nationkey AS ideal_cycle_s FROM {customer}""",
    "f_shifts": """SELECT l_suppkey AS machine_id, l_shipdate AS shift_start, 480 AS planned_min, l_linenumber * 10 AS downtime_min,
        CASE l_returnflag WHEN 'R' THEN 'Breakdown' WHEN 'A' THEN 'Setup' ELSE 'Material' END AS downtime_reason,
        CAST(l_quantity * 10 AS BIGINT) AS total_units, CAST(round(l_discount * 100) AS BIGINT) AS scrap_units FROM {lineitem}""",
    "f_maintenance": """SELECT user_id AS machine_id, ts, CASE event_type WHEN 'error' THEN 'CORRECTIVE' ELSE 'PREVENTIVE' END AS type,
        concat('event ', event_id) AS note FROM {events} WHERE event_type IN ('error', 'signup')""",
    "f_manuals": """SELECT CASE WHEN n_nationkey < 12 THEN 'CNC' ELSE 'PRESS' END AS machine_type, concat('CNC-', n_nationkey) AS section_id,
        n_name AS title, concat('Instructions of ', n_name) AS content FROM {nation}""",
    # network
    "n_sites": "SELECT c_custkey AS site_id, c_mktsegment AS area FROM {customer}",
    "n_kpis": f"SELECT user_id AS site_id, ts, 100 - value / 10 AS availability_pct, {K} / 45.0 AS drop_call_rate_pct FROM {{events}}",
    "n_customers": """SELECT c_custkey AS customer_id, c_name AS first_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'BUSINESS' ELSE 'CONSUMER' END
        AS plan, CAST(30 * (1 + c_nationkey) AS DOUBLE) AS monthly_charge, c_nationkey AS tenure_months,
        CAST(c_nationkey AS BIGINT) AS home_site_id FROM {customer}""",
    "n_tickets": "SELECT user_id AS customer_id, ts AS opened_at, event_id AS ticket_id FROM {events} WHERE event_type = 'error'",
    # retail
    "r_products": """SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_retailprice AS price, p_size > 10 AS returnable
        FROM {part}""",
    "r_customers": f"""SELECT c_custkey AS customer_id, c_name AS name, {EMAIL} AS email,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'GOLD' ELSE 'STANDARD' END AS loyalty_tier FROM {{customer}}""",
    "r_orders": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
        CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'SHIPPED' ELSE 'PROCESSING' END AS status,
        CASE WHEN o_orderstatus = 'F' THEN CAST(s.shipped AS DATE) END AS delivered_date, o_totalprice AS total FROM {orders}
        LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM {lineitem} GROUP BY l_orderkey) s ON s.l_orderkey = o_orderkey""",
    "r_items": """SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
        l_extendedprice AS unit_price FROM {lineitem}""",
    "r_returns": f"""SELECT min({LINE_ID}) AS return_id, l_orderkey AS order_id, 'damaged' AS reason,
        CASE WHEN min(l_linestatus) = 'F' THEN 'APPROVED' ELSE 'REQUESTED' END AS status, CAST(max(l_shipdate) AS DATE) AS requested_at
        FROM {{lineitem}} WHERE l_returnflag = 'R' GROUP BY l_orderkey""",
    # clinical
    "h_patients": "SELECT c_custkey AS subject_id, CASE WHEN c_nationkey < 12 THEN 'F' ELSE 'M' END AS gender FROM {customer}",
    "h_admissions": """SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime, o_orderpriority AS admission_type,
        CASE WHEN o_orderstatus = 'P' THEN 'CLINIC' END AS admission_location, o_orderstatus AS discharge_location,
        CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS hospital_expire_flag,
        CAST(least(90, floor(o_totalprice / 5000)) AS INT) AS age, round(o_totalprice / 10000, 2) AS los_days FROM {orders}""",
    "h_diagnoses": """SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num, p_brand AS icd_code, 10 AS icd_version,
        CASE WHEN p_size > 10 THEN concat(p_type, ' ', p_name) END AS long_title FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "h_labs": """SELECT l_orderkey AS hadm_id, l_shipdate AS charttime, concat('lab ', l_linenumber) AS label, l_quantity AS valuenum,
        CASE WHEN l_returnflag = 'A' THEN 'abnormal' END AS flag, 'mg' AS valueuom FROM {lineitem}""",
    "h_rx": """SELECT l_orderkey AS hadm_id, l_shipdate AS starttime, p_name AS drug, p_type AS route FROM {lineitem}
        JOIN {part} ON p_partkey = l_partkey""",
    "h_icu": f"""SELECT l_orderkey AS hadm_id, {LINE_ID} AS stay_id, concat('unit ', l_suppkey) AS first_careunit, l_shipdate AS intime,
        l_shipdate + INTERVAL 2 DAY AS outtime, l_quantity / 10 AS los FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    "h_notes": """SELECT concat(conv_id, '-', turn) AS note_id, conv_id AS hadm_id, turn AS charttime, role AS note_type, text
        FROM {conversations}""",
    # spend
    "p_subs": """SELECT o_orderkey AS id, concat('subscription ', o_orderkey) AS name, o_orderpriority AS category,
        CAST(round(o_totalprice * 100) AS BIGINT) AS cost_cents,
        CASE o_orderstatus WHEN 'F' THEN 'monthly' WHEN 'O' THEN 'annual' ELSE 'one_time' END AS billing_cycle,
        CASE WHEN o_totalprice < 150000 THEN 'active' WHEN o_totalprice < 250000 THEN 'trial' WHEN o_totalprice < 350000 THEN 'cancelled'
        ELSE 'pending_cancellation' END AS status, CAST(o_orderdate AS DATE) AS renewal_date FROM {orders}""",
    # moderation
    "d_submissions": """SELECT d.doc_id AS id, d.source AS title, d.text AS body, CASE d.lang WHEN 'en' THEN 'blog' WHEN 'fr' THEN 'linkedin'
        WHEN 'de' THEN 'twitter' ELSE 'newsletter' END AS target, CASE WHEN l.quality IS NULL THEN 'pending_review' WHEN l.toxic = 1
        THEN 'rejected' WHEN l.quality = 1 THEN 'approved' ELSE 'revision_requested' END AS status FROM {documents} d
        LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "d_analyses": """SELECT event_id AS id, user_id AS submission_id, CAST(floor(least(100, value)) AS BIGINT) AS compliance_score,
        event_type AS issues, ts AS analyzed_at FROM {events}""",
    "d_guidelines": """SELECT n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'blog' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'twitter'
        ELSE 'press_release' END AS target, n_name AS title, concat('Rules of ', n_name) AS rules, n_nationkey < 18 AS is_active,
        n_nationkey AS created_at FROM {nation}""",
    # rentals
    "b_bookings": """SELECT o_orderkey AS booking_id, o_custkey AS user_id, o_custkey AS property_id, o_orderstatus AS status,
        CAST(o_orderdate AS DATE) AS check_in, CAST(o_orderdate + INTERVAL 3 DAY AS DATE) AS check_out, 2 AS guests_count,
        o_totalprice AS total_amount FROM {orders}""",
    "b_users": f"SELECT c_custkey AS user_id, c_name AS name, {EMAIL} AS email FROM {{customer}}",
    "b_properties": "SELECT c_custkey AS property_id, c_name AS title, c_nationkey AS destination_id FROM {customer}",
    "b_destinations": """SELECT n_nationkey AS destination_id, n_name AS destination, r_name AS country FROM {nation}
        JOIN {region} ON r_regionkey = n_regionkey""",
    "b_reviews": "SELECT l_orderkey AS booking_id, l_linenumber AS rating FROM {lineitem}",
    "t_trips": "SELECT l_suppkey AS pickup_zip, l_linenumber AS dropoff_zip, l_extendedprice AS fare_amount FROM {lineitem}",
    # change history
    "c_changes": """SELECT user_id AS id, event_type AS status, value AS amount, CASE event_type WHEN 'error' THEN 'delete' ELSE 'update' END
        AS _pg_change_type, event_id AS _pg_lsn, 0 AS _pg_xid, ts AS _timestamp, event_id AS _sort_by FROM {events}""",
}
