"""The registered queries written independently in SQL, for checking results against another engine."""

from __future__ import annotations

import re

from .model import FREQUENCY, MOVEMENT, PAYMENTS, REGIONS, STOCK_DAYS, TIERS, TRANSACTION_RULE, VALUE


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}' || lpad(CAST({key} AS VARCHAR), 12, '0')"


def _case(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


def _steps(value: str, steps, operator: str, top: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} {operator} {limit} THEN '{name}'" for limit, name in steps) + f" ELSE '{top}' END"


_PAYMENT = "CASE {0} % 4 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PAYMENTS)) + " END"
_STOCK_DAYS = ", ".join(f"({i + 1}, '{d}')" for i, d in enumerate(STOCK_DAYS))
_KEY = "CAST(year({0}) * 10000 + month({0}) * 100 + day({0}) AS INTEGER)"
_KEPT = "is_complete AND has_quantity AND is_past"

TABLES = {
    "raw_transactions": f"""
        SELECT CASE WHEN l_orderkey % 997 <> 11
                    THEN CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS transaction_id,
               CASE WHEN l_orderkey % 499 = 3 THEN 'not-a-date'
                    WHEN l_orderkey % 331 = 7 THEN strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d')
                    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
               CASE WHEN (l_orderkey + l_suppkey) % 307 <> 5 THEN {_id('ST', 'l_suppkey')} END AS store_id,
               CASE WHEN l_orderkey % 101 <> 9 THEN {_id('CUST', 'o_custkey')} END AS customer_id,
               {_id('P', 'l_partkey')} AS product_id,
               CASE WHEN (l_orderkey + l_partkey) % 211 = 1 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS quantity,
               CAST(CASE WHEN (l_orderkey + l_partkey) % 199 = 2 THEN -CAST(p_retailprice AS DECIMAL(12,2))
                         WHEN (l_orderkey + l_partkey) % 503 = 4 THEN CAST(p_retailprice AS DECIMAL(12,2)) * 20
                         ELSE CAST(p_retailprice AS DECIMAL(12,2)) END AS DECIMAL(12,2)) AS price,
               {_PAYMENT.format('l_orderkey')} AS payment_method,
               CASE WHEN l_linenumber <> 7
                    THEN CAST(CAST(CAST(l_quantity AS INTEGER) AS DECIMAL(10,0)) * CAST(p_retailprice AS DECIMAL(12,2))
                              * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) END AS discount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "staged": """
        SELECT transaction_id, copies, store_id, customer_id, product_id, quantity, abs(price) AS price, payment_method,
               coalesce(discount, 0) AS discount, discount IS NULL AS discount_was_null, price < 0 AS price_was_negative,
               transaction_id IS NOT NULL AND product_id IS NOT NULL AND store_id IS NOT NULL AS is_complete,
               coalesce(quantity > 0, false) AS has_quantity, try_cast(date AS TIMESTAMP) AS date,
               coalesce(try_cast(date AS TIMESTAMP) <= TIMESTAMP '2002-01-01 00:00:00', false) AS is_past
        FROM (SELECT *, count(*) OVER (PARTITION BY transaction_id) AS copies,
                     row_number() OVER (PARTITION BY transaction_id ORDER BY date NULLS LAST, store_id NULLS LAST,
                         customer_id NULLS LAST, product_id NULLS LAST, quantity NULLS LAST, price NULLS LAST,
                         payment_method NULLS LAST, discount NULLS LAST) AS rn
              FROM raw_transactions) WHERE rn = 1""",
    "price_limit": f"""
        SELECT avg(CAST(price AS DOUBLE)) + 3.0 * stddev_samp(CAST(price AS DOUBLE)) AS price_limit
        FROM staged WHERE {_KEPT}""",
    "cleaned": f"""
        SELECT transaction_id, date, store_id, customer_id, product_id, quantity, price, payment_method, discount,
               CAST(price AS DOUBLE) > (SELECT price_limit FROM price_limit) AS is_anomaly
        FROM staged WHERE {_KEPT}""",
    "dim_date": f"""
        SELECT {_KEY.format('d')} AS date_key, d AS date, CAST(year(d) AS INTEGER) AS year,
               CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, dayofweek(d) IN (0, 6) AS is_weekend,
               false AS is_holiday, CAST(NULL AS VARCHAR) AS festival_name
        FROM (SELECT CAST(unnest(generate_series((SELECT date_trunc('year', min(o_orderdate)) FROM orders), (SELECT last_day(date_trunc('year', max(o_orderdate)) + INTERVAL 11 MONTH) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d)""",
    "raw_customers": f"""
        SELECT {_id('CUST', 'c_custkey')} AS customer_id, c_name AS name,
               CASE WHEN c_custkey % 50 = 0 THEN NULL
                    WHEN c_custkey % 50 = 25 THEN 'user' || CAST(c_custkey AS VARCHAR) || '.example.com'
                    ELSE 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
               CASE WHEN c_custkey % 50 <> 0 THEN '+91-' || CAST(c_custkey + 9000000000 AS VARCHAR) END AS phone,
               n_name AS city
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "dim_customer": """
        SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id, name, email, phone, city,
               TIMESTAMP '1995-01-01 00:00:00' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, true AS is_current,
               1 AS version
        FROM raw_customers""",
    "snapshots": f"""
        SELECT customer_id, s.name, 'new' || CAST(k AS VARCHAR) || '@example.org' AS email,
               '080-' || CAST(k + 10000000 AS VARCHAR) AS phone, n_name AS city, snapshot_ts
        FROM (SELECT c_custkey AS k, {_id('CUST', 'c_custkey')} AS customer_id, c_name AS name,
                     CASE WHEN c_custkey % 10 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS nk,
                     TIMESTAMP '2002-01-15 00:00:00' AS snapshot_ts FROM customer
              UNION ALL
              SELECT c_custkey, {_id('CUST', 'c_custkey')}, c_name,
                     CASE WHEN c_custkey % 20 = 0 THEN (c_nationkey + 2) % 25
                          WHEN c_custkey % 10 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END,
                     TIMESTAMP '2002-02-01 00:00:00' FROM customer
              UNION ALL
              SELECT s_suppkey, {_id('CUSTS', 's_suppkey')}, s_name, s_nationkey, TIMESTAMP '2002-01-15 00:00:00' FROM supplier
              UNION ALL
              SELECT s_suppkey, {_id('CUSTS', 's_suppkey')}, s_name, (s_nationkey + 1) % 25,
                     TIMESTAMP '2002-02-01 00:00:00' FROM supplier) s
        JOIN nation ON nk = n_nationkey""",
    "newest": """
        SELECT customer_id, name, email, phone, city FROM (
            SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY snapshot_ts DESC) AS rn FROM snapshots)
        WHERE rn = 1""",
    "new_customers": """
        SELECT (SELECT max(customer_key) FROM dim_customer) + row_number() OVER (ORDER BY customer_id) AS customer_key,
               customer_id, min(name) AS name, min(email) AS email, min(phone) AS phone, min(city) AS city,
               TIMESTAMP '2002-02-01 00:00:00' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, true AS is_current,
               1 AS version
        FROM snapshots WHERE customer_id NOT IN (SELECT customer_id FROM dim_customer) GROUP BY customer_id""",
    "dim_extended": "SELECT * FROM dim_customer UNION ALL SELECT * FROM new_customers",
    "changed": """
        SELECT n.customer_id, n.name, n.email, n.phone, n.city, d.version AS current_version
        FROM newest n JOIN dim_extended d ON n.customer_id = d.customer_id
        WHERE d.is_current AND coalesce(n.city, '') <> coalesce(d.city, '')""",
    "dim_customer_after": """
        SELECT customer_key, customer_id, name, email, phone, city, valid_from,
               CASE WHEN is_current AND customer_id IN (SELECT customer_id FROM changed)
                    THEN TIMESTAMP '2002-02-01 00:00:00' ELSE valid_to END AS valid_to,
               is_current AND customer_id NOT IN (SELECT customer_id FROM changed) AS is_current, version
        FROM dim_extended
        UNION ALL
        SELECT (SELECT max(customer_key) FROM dim_extended) + row_number() OVER (ORDER BY customer_id), customer_id, name,
               email, phone, city, TIMESTAMP '2002-02-01 00:00:00', NULL, true, current_version + 1
        FROM changed""",
    "dim_product": f"""
        SELECT row_number() OVER (ORDER BY product_id) AS product_key, * FROM (
            SELECT {_id('P', 'p_partkey')} AS product_id, p_name AS name, p_type AS category, p_brand AS brand,
                   CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part)""",
    "dim_store": f"""
        SELECT row_number() OVER (ORDER BY store_id) AS store_key, * FROM (
            SELECT {_id('ST', 's_suppkey')} AS store_id, s_name AS store_name, n_name AS city,
                   {_case('n_name', REGIONS, 'Unknown')} AS region
            FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "fact_sales": f"""
        SELECT transaction_id AS sale_id, dd.date_key, customer_key, product_key, store_key, quantity,
               CAST(CAST(quantity AS DECIMAL(10,0)) * t.price - discount AS DECIMAL(18,4)) AS revenue,
               CAST(discount AS DECIMAL(18,4)) AS discount
        FROM cleaned t
        JOIN dim_customer c ON t.customer_id = c.customer_id AND c.is_current
        JOIN dim_product p ON t.product_id = p.product_id
        JOIN dim_store s ON t.store_id = s.store_id
        JOIN dim_date dd ON CAST(t.date AS DATE) = dd.date""",
    "raw_inventory": f"""
        SELECT {_id('ST', 'l_suppkey')} AS store_id,
               CASE WHEN (l_partkey + l_suppkey) % 97 = 0 THEN 'P-UNKNOWN' ELSE {_id('P', 'l_partkey')} END AS product_id,
               date, CAST((l_partkey * 7 + l_suppkey * 13 + m * 31) % 100 AS INTEGER) AS stock_level
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) CROSS JOIN (VALUES {_STOCK_DAYS}) AS v(m, date)""",
    "fact_inventory": f"""
        SELECT CAST(NULL AS BIGINT) AS inventory_id, {_KEY.format('CAST(date AS DATE)')} AS date_key, product_key,
               store_key, stock_level, 20 AS reorder_point
        FROM raw_inventory i JOIN dim_product p ON i.product_id = p.product_id JOIN dim_store s ON i.store_id = s.store_id""",
    "raw_shipments": """
        SELECT 'SHP-' || t AS shipment_id, t AS transaction_id, o_orderdate + INTERVAL 1 DAY + INTERVAL 18 HOUR AS ship_date,
               CASE WHEN l_orderkey % 61 <> 8
                    THEN o_orderdate + to_days(CAST((l_orderkey + l_linenumber) % 10 + 2 AS INTEGER)) + INTERVAL 9 HOUR
                    END AS delivery_date
        FROM (SELECT DISTINCT l_orderkey, l_linenumber,
                     CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS t FROM lineitem)
        JOIN orders ON l_orderkey = o_orderkey""",
    "fact_shipments": f"""
        SELECT shipment_id, dd.date_key, product_key, store_key, CAST(days AS DOUBLE) AS delivery_time,
               coalesce(days <= 5, false) AS on_time_flag
        FROM (SELECT *, CAST(floor((epoch(delivery_date) - epoch(ship_date)) / 86400) AS BIGINT) AS days FROM raw_shipments) s
        JOIN fact_sales f ON f.sale_id = s.transaction_id
        JOIN dim_date dd ON dd.date = CAST(s.ship_date AS DATE)""",
    "month_sales": """
        SELECT year, month, sum(revenue) AS rev, count(sale_id) AS n, sum(quantity) AS units
        FROM fact_sales JOIN dim_date USING (date_key) GROUP BY year, month""",
    "last_days": """
        SELECT CAST(date AS VARCHAR) AS date, CAST(sum(revenue) AS DOUBLE) AS revenue
        FROM fact_sales JOIN dim_date USING (date_key) GROUP BY dim_date.date ORDER BY dim_date.date DESC LIMIT 30""",
    "city_sales": """
        SELECT city, region, count(DISTINCT store_key) AS active_stores, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
               count(sale_id) AS transaction_count, CAST(sum(revenue) AS DOUBLE) / count(*) AS avg_transaction_value,
               CAST(sum(quantity) AS BIGINT) AS total_units_sold,
               round(CAST(sum(revenue) AS DOUBLE) * 100.0 / CAST(sum(sum(revenue)) OVER () AS DOUBLE), 2) AS revenue_share_pct
        FROM fact_sales JOIN dim_store USING (store_key) GROUP BY city, region""",
    "velocity": f"""
        SELECT product_id, name AS product_name, category, CAST(price AS DOUBLE) AS price, total_sold, total_revenue, days_sold,
               first_sale_date, last_sale_date, avg_daily_sales,
               date_diff('day', first_sale_date, last_sale_date) AS sales_span_days,
               CASE WHEN avg_daily_sales > {MOVEMENT[0]} THEN 'Fast Moving'
                    WHEN avg_daily_sales > {MOVEMENT[1]} THEN 'Medium Moving' ELSE 'Slow Moving' END AS movement_category,
               round(avg_daily_sales * 30, 2) AS projected_monthly_sales,
               round(avg_daily_sales * 365, 2) AS projected_annual_sales
        FROM (SELECT product_key, CAST(sum(quantity) AS BIGINT) AS total_sold, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
                     count(DISTINCT date_key) AS days_sold, min(date) AS first_sale_date, max(date) AS last_sale_date,
                     CAST(sum(quantity) AS DOUBLE) / CAST(count(DISTINCT date_key) AS DOUBLE) AS avg_daily_sales
              FROM fact_sales JOIN dim_date USING (date_key) GROUP BY product_key)
        JOIN dim_product USING (product_key)""",
    "turnover": """
        SELECT product_id, name AS product_name, category, total_units_sold, round(mean_stock, 2) AS avg_stock_level,
               round(CAST(total_units_sold AS DOUBLE) / nullif(mean_stock, 0), 2) AS inventory_turnover_ratio
        FROM (SELECT product_key, CAST(sum(quantity) AS BIGINT) AS total_units_sold FROM fact_sales GROUP BY product_key)
        JOIN (SELECT product_key, CAST(sum(stock_level) AS DOUBLE) / CAST(count(stock_level) AS DOUBLE) AS mean_stock
              FROM fact_inventory GROUP BY product_key) USING (product_key)
        JOIN dim_product USING (product_key)""",
    "clv": f"""
        SELECT city, {_case('city', TIERS, 'Tier-2')} AS city_tier, count(*) AS customer_count,
               CAST(sum(rev) AS DOUBLE) AS total_revenue, CAST(sum(rev) AS DOUBLE) / count(*) AS avg_clv,
               CAST(sum(n) AS BIGINT) AS total_transactions,
               CAST(sum(rev) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS avg_transaction_value,
               CAST(sum(date_diff('day', first_day, last_day)) AS DOUBLE) / count(*) AS customer_lifespan_days,
               {_steps('CAST(sum(n) AS DOUBLE) / count(*)', FREQUENCY, '<=', 'Loyal')} AS purchase_frequency_segment,
               {_steps('CAST(sum(rev) AS DOUBLE) / count(*)', VALUE, '<', 'Premium')} AS value_segment
        FROM (SELECT customer_key, c.city, sum(revenue) AS rev, count(sale_id) AS n, min(date) AS first_day,
                     max(date) AS last_day
              FROM fact_sales JOIN dim_customer c USING (customer_key) JOIN dim_date USING (date_key)
              GROUP BY customer_key, c.city) GROUP BY city""",
    "baskets": "SELECT DISTINCT customer_key, date_key, product_key FROM fact_sales",
    "product_baskets": "SELECT product_key, count(*) AS n FROM baskets GROUP BY product_key",
    "pairs": """
        SELECT a.product_key AS a, b.product_key AS b, count(*) AS co
        FROM baskets a JOIN baskets b ON a.customer_key = b.customer_key AND a.date_key = b.date_key
             AND a.product_key < b.product_key
        GROUP BY a.product_key, b.product_key""",
    "top_pairs": """
        SELECT pa.product_id AS product_a, pb.product_id AS product_b, co AS co_occurrence_count,
               round(CAST(co AS DOUBLE) / CAST(ca.n AS DOUBLE), 4) AS confidence,
               round((CAST(co AS DOUBLE) / CAST(ca.n AS DOUBLE)) / (CAST(cb.n AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE)
                   FROM (SELECT DISTINCT customer_key, date_key FROM baskets))), 4) AS lift, ca.n * cb.n AS expected, a, b
        FROM pairs JOIN product_baskets ca ON ca.product_key = a JOIN product_baskets cb ON cb.product_key = b
        JOIN dim_product pa ON pa.product_key = a JOIN dim_product pb ON pb.product_key = b
        ORDER BY co DESC, expected, a, b LIMIT 20""",
    "features": """
        SELECT product_id, store_id, category, stock_level AS current_stock, coalesce(avg_qty, 0) AS avg_qty,
               coalesce(std_qty, 0) AS std_qty
        FROM (SELECT *, row_number() OVER (PARTITION BY product_key, store_key
                                           ORDER BY date_key DESC, stock_level DESC) AS rn FROM fact_inventory) i
        LEFT JOIN (SELECT product_key, store_key, avg(quantity) AS avg_qty, coalesce(stddev_samp(quantity), 0) AS std_qty
                   FROM fact_sales GROUP BY product_key, store_key) USING (product_key, store_key)
        JOIN dim_product USING (product_key) JOIN dim_store USING (store_key) WHERE rn = 1""",
    "rule_scores": """
        SELECT product_id, store_id, CASE WHEN current_stock < avg_qty THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
               CAST(trunc(greatest(avg_qty * 2 - current_stock, 0)) AS INTEGER) AS recommended_reorder,
               CASE WHEN current_stock < avg_qty THEN 'Critical' ELSE 'Low' END AS risk_level,
               CASE WHEN current_stock < avg_qty THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS ml_confidence,
               CAST(current_stock AS DOUBLE) AS current_stock, avg_qty AS avg_daily_demand,
               CASE WHEN avg_qty > 0 THEN round(std_qty / avg_qty, 2) ELSE 0.0 END AS volatility_cv
        FROM features""",
    "decisions": """
        SELECT row_number() OVER (ORDER BY stamp, product_id, store_id) AS id, stamp AS timestamp, *
        FROM rule_scores CROSS JOIN (VALUES (TIMESTAMP '2002-01-01'), (TIMESTAMP '2002-01-02')) AS d(stamp)""",
    "live_orders": f"""
        SELECT event_id AS order_id, ts AS timestamp, 'P' || lpad(CAST(event_id % (SELECT count(*) FROM part) AS VARCHAR), 12, '0') AS product_id,
               'ST' || lpad(CAST(event_id % (SELECT count(*) FROM supplier) AS VARCHAR), 12, '0') AS store_id,
               CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 3 + 1 AS INTEGER) AS quantity,
               CAST(value AS DECIMAL(12,2)) AS price, CAST(user_id AS VARCHAR) AS customer_id,
               {_PAYMENT.format('event_id')} AS payment_method, 'events' AS order_source
        FROM events WHERE event_type = 'purchase'""",
    "drift_batch": """
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id, l_partkey AS product_id,
               l_suppkey AS store_id, l_returnflag AS return_flag, l_tax AS tax_rate, nullif(o_orderpriority, '5-LOW') AS priority,
               o_orderstatus AS order_status, l_shipdate AS shipped_at, l_linestatus AS line_status, p_size AS part_size,
               p_name AS part_label, p_brand AS part_brand
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "drift_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n, count({c}) AS present, count(DISTINCT {c}) AS variety "
        "FROM drift_batch"
        for c, t in (
            ("return_flag", "string"), ("tax_rate", "double"), ("priority", "string"), ("order_status", "string"),
            ("shipped_at", "timestamp_ntz"), ("line_status", "string"), ("part_size", "int"), ("part_label", "string"),
            ("part_brand", "string"),
        )
    ),
    "drift_samples": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, string_agg(value, '|' ORDER BY transaction_id, product_id, store_id, value) AS sample_values "
        f"FROM (SELECT transaction_id, product_id, store_id, CAST({c} AS VARCHAR) AS value FROM drift_batch WHERE {c} IS NOT NULL "
        "ORDER BY ALL LIMIT 5)"
        for c in ("return_flag", "tax_rate", "priority", "order_status", "shipped_at", "line_status", "part_size", "part_label", "part_brand")
    ),
    "changes": """
        SELECT 'new_column' AS change_type, column_name, data_type,
               least((1.0::DOUBLE - (CAST(n AS DOUBLE) - CAST(present AS DOUBLE)) / CAST(n AS DOUBLE)) * 0.3::DOUBLE
               + CASE WHEN CAST(variety AS DOUBLE) / CAST(n AS DOUBLE) > 0.01
                       AND CAST(variety AS DOUBLE) / CAST(n AS DOUBLE) < 0.99 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END
               + CASE WHEN data_type = 'string' THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END, 1.0::DOUBLE) AS confidence
        FROM drift_profile""",
    "visits": """
        WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR, true) AS opens
                   FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
             n AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM e)
        SELECT user_id, min(ts) AS visit_start, max(ts) AS visit_end, count(*) AS events,
               count(*) FILTER (event_type = 'purchase') AS purchases, arg_min(event_type, struct_pack(ts := ts, k := event_id)) AS first_event,
               arg_max(event_type, struct_pack(ts := ts, k := event_id)) AS last_event
        FROM n GROUP BY user_id, visit""",
    "run_events": """
        SELECT o_orderkey AS run_id, o_orderpriority AS pipeline_name, o_orderdate AS event_time, 'running' AS status,
               CAST(NULL AS BIGINT) AS rows_processed, CAST(NULL AS BIGINT) AS rows_quarantined,
               CAST(NULL AS VARCHAR) AS error_message FROM orders
        UNION ALL
        SELECT o_orderkey, o_orderpriority, o_orderdate + to_seconds(30 + o_orderkey % 600),
               CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'failed' END, CAST(floor(o_totalprice) AS BIGINT),
               o_orderkey % 13, CASE WHEN o_orderstatus <> 'F' THEN 'status ' || o_orderstatus END
        FROM orders WHERE o_orderstatus <> 'P'""",
    "runs": """
        SELECT run_id, any_value(pipeline_name) AS pipeline_name, min(event_time) AS start_time,
               CASE WHEN count(*) > 1 THEN max(event_time) END AS end_time, arg_max(status, event_time) AS status,
               max(rows_processed) AS rows_processed, max(rows_quarantined) AS rows_quarantined,
               max(error_message) AS error_message,
               CASE WHEN count(*) > 1 THEN CAST(epoch_us(max(event_time)) - epoch_us(min(event_time)) AS DOUBLE) / 1000000.0
                    END AS duration_seconds
        FROM run_events GROUP BY run_id""",
    "quarantine_log": "SELECT event_type AS quarantine_reason, ts AS timestamp FROM events WHERE event_type = 'error'",
}

_REASON = "concat_ws(';', " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 'missing_required_value:{c}' END" for c in sorted(TRANSACTION_RULE.required)
) + ")"
_ANALYST = """
    SELECT sale_id, date_key, product_key, store_key, quantity, CAST(revenue AS DOUBLE) AS revenue,
           concat('XXXXX-', right(phone, 4)) AS phone_masked,
           concat(left(email, 1), '***@', split_part(email, '@', 2)) AS email_masked, c.city AS customer_city
    FROM fact_sales JOIN dim_customer c USING (customer_key)"""
_FINANCE = """
    SELECT sale_id, date_key, customer_key, product_key, store_key, quantity, CAST(revenue AS DOUBLE) AS revenue,
           CAST(discount AS DOUBLE) AS discount, c.name AS customer_name, email, phone, c.city AS customer_city, p.name AS product_name,
           p.category AS product_category, CAST(p.price AS DOUBLE) AS product_price,
           CAST(revenue - p.price * quantity AS DOUBLE) AS profit
    FROM fact_sales JOIN dim_customer c USING (customer_key) JOIN dim_product p USING (product_key)"""
_MANAGER = """
    SELECT sale_id, date_key, product_key, store_key, s.store_id, s.store_name, quantity, CAST(revenue AS DOUBLE) AS revenue,
           concat('XXXXX-', right(phone, 4)) AS phone_masked,
           concat(left(email, 1), '***@', split_part(email, '@', 2)) AS email_masked, c.city AS customer_city
    FROM fact_sales JOIN dim_customer c USING (customer_key) JOIN dim_store s USING (store_key)"""
_GROWTH = """
    CAST(lag(rev) OVER (ORDER BY year, month) AS DOUBLE) AS prev_month_revenue,
    round(CAST(rev - lag(rev) OVER (ORDER BY year, month) AS DOUBLE) * 100.0
          / nullif(CAST(lag(rev) OVER (ORDER BY year, month) AS DOUBLE), 0), 2)"""
_ALERTS = """
    SELECT order_id, timestamp, o.product_id, o.store_id, risk_level, ml_confidence AS confidence, recommended_reorder
    FROM live_orders o JOIN rule_scores r ON o.product_id = r.product_id AND o.store_id = r.store_id
    WHERE risk_level IN ('High', 'Critical')"""
_DECISION = """
    SELECT n_changes, n_high, n_low, action,
           CASE action WHEN 'quarantine_all' THEN 'Mass low-confidence changes' WHEN 'manual_review' THEN 'Requires review'
                ELSE '' END AS reason
    FROM (SELECT *, CASE WHEN n_changes = 0 THEN 'none' WHEN n_low > 5 THEN 'quarantine_all'
                         WHEN n_high = n_changes AND n_changes <= 3 THEN 'auto_approve' ELSE 'manual_review' END AS action
          FROM (SELECT count(*) AS n_changes, count(*) FILTER (confidence >= 0.75) AS n_high,
                       count(*) FILTER (confidence < 0.75) AS n_low FROM changes))"""

FINAL = {
    "k1_daily_revenue": """
        SELECT date, year, month, day, CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type,
               CASE WHEN is_holiday THEN 'Holiday' ELSE 'Regular' END AS holiday_type, festival_name,
               CAST(sum(revenue) AS DOUBLE) AS daily_revenue, count(sale_id) AS transaction_count,
               CAST(sum(revenue) AS DOUBLE) / count(*) AS avg_transaction_value,
               CAST(sum(quantity) AS BIGINT) AS total_units_sold
        FROM fact_sales JOIN dim_date USING (date_key) GROUP BY ALL ORDER BY date DESC""",
    "k1a_last_30_days": "SELECT * FROM last_days",
    "k2_monthly_growth": f"""
        SELECT year, month, monthname(make_date(2000, month, 1)) AS month_name, CAST(rev AS DOUBLE) AS monthly_revenue,
               n AS transaction_count, CAST(rev AS DOUBLE) / n AS avg_transaction_value,
               CAST(units AS BIGINT) AS total_units_sold, {_GROWTH} AS revenue_growth_pct
        FROM month_sales ORDER BY year, month""",
    "k3_city_sales": "SELECT * FROM city_sales ORDER BY total_revenue DESC, city, region",
    "k4_top_products": """
        SELECT product_id, name AS product_name, category, brand, CAST(sum(quantity) AS BIGINT) AS total_quantity_sold,
               CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(sale_id) AS transaction_count,
               CAST(sum(revenue) AS DOUBLE) / count(*) AS avg_revenue_per_transaction,
               CAST(price AS DOUBLE) AS avg_product_price,
               round(CAST(sum(revenue) AS DOUBLE) * 100.0 / CAST(sum(sum(revenue)) OVER () AS DOUBLE), 2) AS revenue_share_pct,
               row_number() OVER (ORDER BY sum(revenue) DESC, product_id) AS revenue_rank
        FROM fact_sales JOIN dim_product USING (product_key) GROUP BY product_id, name, category, brand, price
        ORDER BY revenue_rank LIMIT 10""",
    "k5_velocity": "SELECT * FROM velocity ORDER BY avg_daily_sales DESC, product_id",
    "k5_stockout_top20": "SELECT * FROM velocity ORDER BY avg_daily_sales DESC, product_id LIMIT 20",
    "k6_turnover": "SELECT * FROM turnover ORDER BY inventory_turnover_ratio DESC NULLS LAST, product_id",
    "k6_turnover_top20": "SELECT * FROM turnover ORDER BY inventory_turnover_ratio DESC NULLS LAST, product_id LIMIT 20",
    "k7_delivery": """
        SELECT CAST(date_trunc('month', date) AS TIMESTAMP) AS delivery_month, count(*) AS total_deliveries,
               round(CAST(sum(delivery_time) AS DOUBLE) / count(delivery_time), 2) AS avg_delivery_days,
               min(delivery_time) AS min_delivery_days, max(delivery_time) AS max_delivery_days,
               round(CAST(sum(CASE WHEN on_time_flag THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / count(*), 2) AS on_time_pct
        FROM fact_shipments JOIN dim_date USING (date_key) GROUP BY 1 ORDER BY 1 DESC""",
    "k8_seasonal": f"""
        SELECT year, month, monthname(make_date(2000, month, 1)) AS month_name,
               CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4, 5) THEN 'Spring'
                    WHEN month IN (6, 7, 8) THEN 'Summer' ELSE 'Monsoon' END AS season,
               CAST(rev AS DOUBLE) AS monthly_revenue, n AS transaction_count, CAST(rev AS DOUBLE) / n AS avg_transaction_value,
               CAST(units AS BIGINT) AS total_units_sold,
               round(CAST(rev AS DOUBLE) * 100.0 / CAST(sum(rev) OVER () AS DOUBLE), 2) AS revenue_share_pct,
               {_GROWTH} AS month_over_month_growth_pct
        FROM month_sales ORDER BY year, month""",
    "k9_new_vs_returning": """
        SELECT date, total_customers, new_customers, returning_customers, total_revenue,
               round(CAST(new_customers AS DOUBLE) * 100.0 / nullif(total_customers, 0), 2) AS new_customer_pct,
               round(CAST(returning_customers AS DOUBLE) * 100.0 / nullif(total_customers, 0), 2) AS returning_customer_pct
        FROM (SELECT date, count(DISTINCT f.customer_key) AS total_customers,
                     count(DISTINCT CASE WHEN f.date_key = first_key THEN f.customer_key END) AS new_customers,
                     count(DISTINCT CASE WHEN f.date_key > first_key THEN f.customer_key END) AS returning_customers,
                     CAST(sum(revenue) AS DOUBLE) AS total_revenue
              FROM fact_sales f
              JOIN (SELECT customer_key, min(date_key) AS first_key FROM fact_sales GROUP BY customer_key) m
                ON m.customer_key = f.customer_key
              JOIN dim_date d ON d.date_key = f.date_key GROUP BY date)
        ORDER BY date DESC""",
    "k10_clv": "SELECT * FROM clv ORDER BY total_revenue DESC, city",
    "k11_basket": "SELECT product_a, product_b, co_occurrence_count, confidence, lift FROM top_pairs ORDER BY co_occurrence_count DESC, expected, a, b",
    "k11_large_baskets": """
        WITH b AS (SELECT DISTINCT s_nationkey AS c, year(o_orderdate) AS d, l_partkey AS p
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
             n AS (SELECT p, count(*) AS n FROM b GROUP BY p),
             t AS (SELECT x.p AS a, y.p AS b, count(*) AS co FROM b x JOIN b y ON x.c = y.c AND x.d = y.d AND x.p < y.p GROUP BY ALL)
        SELECT pa.p_name AS product_a, pb.p_name AS product_b, co AS co_occurrence_count,
               round(CAST(co AS DOUBLE) / CAST(na.n AS DOUBLE), 4) AS confidence,
               round((CAST(co AS DOUBLE) / CAST(na.n AS DOUBLE)) / (CAST(nb.n AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE)
                   FROM (SELECT DISTINCT c, d FROM b))), 4) AS lift
        FROM t JOIN n na ON na.p = a JOIN n nb ON nb.p = b JOIN part pa ON pa.p_partkey = a JOIN part pb ON pb.p_partkey = b
        ORDER BY co DESC, na.n * nb.n, a, b LIMIT 20""",
    "k12_summary": """
        SELECT 'Total Revenue' AS metric, CAST(sum(revenue) AS DOUBLE) AS value,
               '₹' || CAST(CAST(round(sum(revenue), 2) AS DECIMAL(38,2)) AS VARCHAR) AS formatted_value FROM fact_sales
        UNION ALL SELECT 'Total Transactions', CAST(count(sale_id) AS DOUBLE), CAST(count(sale_id) AS VARCHAR) FROM fact_sales
        UNION ALL SELECT 'Total Customers', CAST(count(DISTINCT customer_key) AS DOUBLE),
                         CAST(count(DISTINCT customer_key) AS VARCHAR) FROM fact_sales
        UNION ALL SELECT 'Total Products', CAST(count(DISTINCT product_key) AS DOUBLE),
                         CAST(count(DISTINCT product_key) AS VARCHAR) FROM fact_sales
        UNION ALL SELECT 'Total Stores', CAST(count(DISTINCT store_key) AS DOUBLE),
                         CAST(count(DISTINCT store_key) AS VARCHAR) FROM fact_sales""",
    "k13_ai_decisions": """
        SELECT 'ML-' || CAST(id AS VARCHAR) AS decision_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
               'stockout_risk_classifier' AS decision_type, product_id || ' @ ' || store_id AS entity,
               'Recommend reorder of ' || CAST(recommended_reorder AS VARCHAR) || ' units' AS action, confidence,
               risk_level || ' stockout risk' AS impact, 'executed' AS status
        FROM decisions ORDER BY decisions.timestamp DESC, id DESC LIMIT 20""",
    "k14_headline": """
        SELECT round(sum(revenue), 4) AS total_revenue, round(avg(revenue), 4) AS avg_daily_revenue,
               round((max(CASE WHEN rn = 1 THEN revenue END) - max(CASE WHEN rn = 2 THEN revenue END))
                     / max(CASE WHEN rn = 2 THEN revenue END) * 100, 6) AS revenue_trend_pct
        FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM last_days)""",
    "k15_totals": """
        SELECT (SELECT count(*) FROM city_sales) AS total_cities,
               (SELECT CAST(sum(active_stores) AS BIGINT) FROM city_sales) AS total_stores,
               (SELECT CAST(sum(customer_count) AS BIGINT) FROM clv) AS total_customers""",
    "k16_daily_bars": """
        SELECT date, revenue, round(revenue / max(revenue) OVER () * 100, 2) AS pct_of_max,
               revenue > avg(revenue) OVER () AS is_above_avg FROM last_days ORDER BY date DESC LIMIT 10""",
    "k17_city_bars": """
        SELECT city, region, total_revenue, round(total_revenue / max(total_revenue) OVER () * 100, 2) AS pct_of_max
        FROM city_sales ORDER BY total_revenue DESC, city, region LIMIT 8""",
    "k18_city_shares": """
        SELECT city, customer_count, total_revenue,
               round(CAST(customer_count AS DOUBLE) * 100.0 / CAST(sum(customer_count) OVER () AS DOUBLE), 2) AS customer_pct,
               round(total_revenue * 100.0 / sum(total_revenue) OVER (), 2) AS revenue_pct
        FROM clv ORDER BY total_revenue DESC, city LIMIT 6""",
    "k19_stockout_top10": "SELECT * FROM velocity ORDER BY avg_daily_sales DESC, product_id LIMIT 10",
    "k19_pairs_top10": "SELECT product_a, product_b, co_occurrence_count, confidence, lift FROM top_pairs ORDER BY co_occurrence_count DESC, expected, a, b LIMIT 10",
    "c_clean": """
        SELECT transaction_id, CAST(date AS DATE) AS date, store_id, customer_id, product_id, quantity,
               CAST(price AS DOUBLE) AS price, payment_method, CAST(discount AS DOUBLE) AS discount, is_anomaly FROM cleaned""",
    "c_report": f"""
        SELECT metric, value FROM (
            SELECT CAST(sum(copies) AS DOUBLE) AS initial_rows, CAST(sum(copies) - count(*) AS DOUBLE) AS duplicates_removed,
                   CAST(count(*) FILTER (discount_was_null) AS DOUBLE) AS nulls_fixed,
                   CAST(count(*) FILTER (NOT is_complete) AS DOUBLE) AS critical_rows_removed,
                   CAST(count(*) FILTER (is_complete AND price_was_negative) AS DOUBLE) AS invalid_values_fixed,
                   CAST(count(*) FILTER (is_complete AND NOT has_quantity) AS DOUBLE) AS invalid_quantity_removed,
                   CAST(count(*) FILTER (is_complete AND has_quantity AND NOT is_past) AS DOUBLE) AS future_rows_removed,
                   CAST((SELECT count(*) FROM cleaned WHERE is_anomaly) AS DOUBLE) AS anomalies_flagged,
                   CAST(count(*) FILTER ({_KEPT}) AS DOUBLE) AS final_rows,
                   round(CAST(count(*) FILTER ({_KEPT}) AS DOUBLE) * 100.0 / CAST(sum(copies) AS DOUBLE), 2) AS retention_rate
            FROM staged) UNPIVOT (value FOR metric IN (initial_rows, duplicates_removed, nulls_fixed, critical_rows_removed,
                invalid_values_fixed, invalid_quantity_removed, future_rows_removed, anomalies_flagged, final_rows,
                retention_rate))""",
    "v_valid": f"""
        SELECT transaction_id, date, store_id, customer_id, product_id, quantity, CAST(price AS DOUBLE) AS price,
               payment_method, CAST(discount AS DOUBLE) AS discount FROM raw_transactions WHERE {_REASON} = ''""",
    "v_quarantine": f"""
        SELECT transaction_id, date, store_id, customer_id, product_id, quantity, CAST(price AS DOUBLE) AS price,
               payment_method, CAST(discount AS DOUBLE) AS discount, {_REASON} AS quarantine_reason
        FROM raw_transactions WHERE {_REASON} <> ''""",
    "c_first_copy": """
        SELECT transaction_id, store_id, product_id, quantity, store_id IS NOT NULL AS is_complete FROM (
            SELECT 'T' || CAST(event_id // 2 AS VARCHAR) AS transaction_id,
                   CASE WHEN event_id % 3 <> 0 THEN 'ST' || CAST(user_id AS VARCHAR) END AS store_id,
                   'P' || CAST(event_id % 10 AS VARCHAR) AS product_id, CAST(event_id % 4 + 1 AS INTEGER) AS quantity,
                   row_number() OVER (PARTITION BY event_id // 2 ORDER BY event_id) AS rn FROM events) WHERE rn = 1""",
    "v_counts": f"""
        SELECT 'transactions' AS table_name, count(*) FILTER ({_REASON} = '') AS valid_rows,
               count(*) FILTER ({_REASON} <> '') AS quarantined_rows FROM raw_transactions""",
    "v_missing_column": """
        SELECT 'missing_required_column:currency' || CASE WHEN store_id IS NULL THEN ';missing_required_value:store_id'
               ELSE '' END AS quarantine_reason, count(*) AS row_count FROM raw_transactions GROUP BY 1""",
    "v_drift_scores": """
        SELECT change_type, column_name, data_type, round(confidence, 6) AS confidence, sample_values
        FROM changes JOIN drift_samples USING (column_name)""",
    "v_decision": _DECISION,
    "v_change_log": f"""
        SELECT 'transactions' AS table_name, change_type, column_name, '' AS old_value, data_type AS new_value,
               round(confidence, 6) AS confidence_score, (SELECT action FROM ({_DECISION})) AS status, 0 AS affected_rows
        FROM changes""",
    "v_queue_expanded": """
        SELECT change_type AS type, column_name AS "column", round(confidence, 6) AS confidence, data_type, sample_values
        FROM changes JOIN drift_samples USING (column_name)""",
    "v_approved": """
        SELECT column_name, 'approved' AS status, 'admin' AS approved_by, TIMESTAMP '2002-01-03 00:00:00' AS approved_at
        FROM changes""",
    "v_summary": f"""
        SELECT n_changes AS total_changes, CASE WHEN action IN ('manual_review', 'quarantine_all') THEN n_changes ELSE 0 END
               AS pending_approval, CASE action WHEN 'auto_approve' THEN n_changes ELSE 0 END AS auto_approved
        FROM ({_DECISION})""",
    "v_history": f"""
        SELECT TIMESTAMP '2002-01-02 00:00:00' AS detected_at, 'transactions' AS table_name, change_type, column_name,
               round(confidence, 6) AS confidence_score, (SELECT action FROM ({_DECISION})) AS status
        FROM changes ORDER BY column_name LIMIT 20""",
    "v_pending": f"SELECT 'transactions' AS table_name, action, reason FROM ({_DECISION})",
    "d_dim_date": "SELECT * FROM dim_date",
    "d_dim_customer": "SELECT * FROM dim_customer",
    "d_dim_product": """
        SELECT product_key, product_id, name, category, brand, CAST(price AS DOUBLE) AS price FROM dim_product""",
    "d_dim_store": "SELECT * FROM dim_store",
    "d_store_regions": "SELECT region, count(*) AS store_count FROM dim_store GROUP BY region",
    "d_fact_sales": """
        SELECT sale_id, date_key, customer_key, product_key, store_key, quantity, CAST(revenue AS DOUBLE) AS revenue,
               CAST(discount AS DOUBLE) AS discount FROM fact_sales""",
    "d_fact_inventory": "SELECT date_key, product_key, store_key, stock_level, reorder_point FROM fact_inventory",
    "d_fact_shipments": "SELECT * FROM fact_shipments",
    "d_unmatched": """
        SELECT count(*) AS unmatched_rows FROM raw_shipments
        WHERE transaction_id NOT IN (SELECT sale_id FROM fact_sales)
           OR CAST(ship_date AS DATE) NOT IN (SELECT date FROM dim_date)""",
    "d_unresolved_inventory": """
        SELECT count(*) AS unresolved_rows FROM raw_inventory WHERE product_id NOT IN (SELECT product_id FROM dim_product)
           OR store_id NOT IN (SELECT store_id FROM dim_store)""",
    "d_row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) = 0 AS is_empty FROM {t}"
        for t in ("dim_date", "dim_customer", "dim_product", "dim_store", "fact_sales", "fact_inventory", "fact_shipments")
    ),
    "e_latest_snapshot": "SELECT * FROM newest",
    "e_new_customers": "SELECT * FROM new_customers",
    "e_changed_customers": "SELECT * FROM changed",
    "e_scd2_apply": "SELECT * FROM dim_customer_after",
    "e_scd2_parts": "SELECT * FROM dim_customer_after",
    "e_orders_at": """
        WITH v AS (
            SELECT c_custkey, c_nationkey, k, TIMESTAMP '1992-03-01 00:00:00' + to_days(CAST(500 * k + c_custkey % 100 AS INTEGER)) AS valid_from,
                   CASE WHEN k < c_custkey % 5 THEN TIMESTAMP '1992-03-01 00:00:00' + to_days(CAST(500 * (k + 1) + c_custkey % 100 AS INTEGER)) END AS valid_to
            FROM customer, range(5) t(k) WHERE k <= c_custkey % 5)
        SELECT o_orderkey, o_custkey, o_orderdate AS ordered_at, CAST(k + 1 AS INTEGER) AS version,
               CAST((c_nationkey + k) % 25 AS INTEGER) AS nation
        FROM orders JOIN v ON c_custkey = o_custkey AND o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to)""",
    "e_scd2_twice": "SELECT * FROM dim_customer_after",
    "e_scd2_repeated": "SELECT * FROM dim_customer_after",
    "e_scd2_checks": """
        SELECT 'duplicate_version' AS check_name, count(*) AS violations FROM (
            SELECT customer_id, version FROM dim_customer_after GROUP BY customer_id, version HAVING count(*) > 1)
        UNION ALL SELECT 'several_current', count(*) FROM (
            SELECT customer_id FROM dim_customer_after WHERE is_current GROUP BY customer_id HAVING count(*) > 1)
        UNION ALL SELECT 'missing_customer', count(DISTINCT customer_id) FROM newest
                  WHERE customer_id NOT IN (SELECT customer_id FROM dim_customer_after)""",
    "g_analyst": _ANALYST,
    "g_analyst_page": _ANALYST + " ORDER BY date_key DESC, sale_id LIMIT 100",
    "g_store_manager": _MANAGER + " WHERE s.store_id = 'ST000000000007'",
    "g_store_manager_page": _MANAGER + " ORDER BY date_key DESC, sale_id LIMIT 100",
    "g_finance": _FINANCE,
    "g_finance_page": _FINANCE + " ORDER BY date_key DESC, sale_id LIMIT 100",
    "g_admin": """
        SELECT 'fact_sales' AS table_name, count(*) AS row_count, min(date_key) AS min_date_key, max(date_key) AS max_date_key,
               CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM fact_sales
        UNION ALL SELECT 'dim_customer', count(*), NULL, NULL, NULL FROM dim_customer
        UNION ALL SELECT 'dim_product', count(*), NULL, NULL, NULL FROM dim_product
        UNION ALL SELECT 'dim_store', count(*), NULL, NULL, NULL FROM dim_store
        UNION ALL SELECT 'dim_date', count(*), min(date_key), max(date_key), NULL FROM dim_date""",
    "g_masked_customers": """
        SELECT customer_key, customer_id, name, city, concat('XXXXX-', right(phone, 4)) AS phone_masked,
               concat(left(email, 1), '***@', split_part(email, '@', 2)) AS email_masked, valid_from, valid_to, is_current,
               version FROM dim_customer""",
    "a_features": """
        SELECT product_id, store_id, category, current_stock, round(avg_qty, 6) AS avg_qty, round(std_qty, 6) AS std_qty
        FROM features""",
    "a_category_codes": """
        SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS category_code
        FROM (SELECT DISTINCT category FROM features)""",
    "a_labels": """
        SELECT product_id, store_id, CAST(current_stock < avg_qty AS INTEGER) AS risk,
               round(greatest(avg_qty * 2 - current_stock, 0), 6) AS reorder_qty FROM features""",
    "a_rule_scores": """
        SELECT product_id, store_id, confidence, recommended_reorder, risk_level, ml_confidence, current_stock,
               round(avg_daily_demand, 6) AS avg_daily_demand FROM rule_scores""",
    "a_scan_all": """
        SELECT product_id, store_id, risk_level, confidence * 100 AS confidence_pct, recommended_reorder FROM rule_scores""",
    "a_decision_log": """
        SELECT id, timestamp, 'stockout_risk_classifier' AS model_name, product_id, store_id,
               CAST(recommended_reorder AS DOUBLE) AS prediction, confidence FROM decisions""",
    "a_latest_decisions": """
        SELECT store_id, product_id, p.name AS product_name, store_name, CAST(recommended_reorder AS DOUBLE) AS recommended_reorder,
               confidence, risk_level, current_stock, round(avg_daily_demand, 6) AS avg_daily_demand,
               round(current_stock / nullif(avg_daily_demand, 0), 1) AS days_remaining
        FROM decisions JOIN dim_product p USING (product_id) JOIN dim_store USING (store_id)
        WHERE timestamp = TIMESTAMP '2002-01-02' AND risk_level IN ('High', 'Critical')
        ORDER BY days_remaining NULLS LAST, product_id, store_id, id LIMIT 20""",
    "a_reasoning": """
        SELECT id, timestamp, store_id, product_id, CAST(recommended_reorder AS DOUBLE) AS prediction, confidence, risk_level,
               current_stock, round(avg_daily_demand, 6) AS avg_daily_demand
        FROM decisions ORDER BY timestamp DESC, id DESC LIMIT 50""",
    "t_orders": """
        SELECT order_id, timestamp, product_id, store_id, quantity, CAST(price AS DOUBLE) AS price, customer_id,
               payment_method, order_source FROM live_orders""",
    "t_alerts": _ALERTS,
    "t_messages": f"""
        SELECT order_id, concat('{{"type":"order","order_id":', order_id, ',"product_id":"', product_id, '","store_id":"', store_id,
                                '","price":', CAST(price AS DOUBLE), '}}') AS body FROM live_orders
        UNION ALL
        SELECT order_id, concat('{{"type":"ml_alert","product_id":"', product_id, '","store_id":"', store_id, '","risk_level":"', risk_level,
                                '","confidence":', CAST(confidence AS DOUBLE), ',"reorder":', recommended_reorder, '}}') FROM ({_ALERTS})""",
    "t_orders_folded": """
        SELECT order_id, timestamp, product_id, store_id, quantity, CAST(price AS DOUBLE) AS price, customer_id,
               payment_method, order_source FROM live_orders""",
    "t_sessions": """
        SELECT * FROM visits WHERE visit_end + INTERVAL 12 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 DAY""",
    "t_visits": """
        SELECT * FROM visits WHERE visit_end + INTERVAL 12 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 DAY""",
    "t_sessions_batch": "SELECT * FROM visits",
    "t_daily_window": """
        SELECT CAST(timestamp AS DATE) AS day, count(*) AS orders, CAST(sum(price * quantity) AS DOUBLE) AS revenue,
               round(CAST(sum(price * quantity) AS DOUBLE) / count(*), 6) AS avg_order_value
        FROM live_orders GROUP BY 1""",
    "t_daily_repeated": """
        SELECT CAST(timestamp AS DATE) AS day, count(*) AS orders, CAST(sum(price * quantity) AS DOUBLE) AS revenue,
               round(CAST(sum(price * quantity) AS DOUBLE) / count(*), 6) AS avg_order_value
        FROM live_orders GROUP BY 1""",
    "t_day_stats": """
        SELECT count(*) AS orders_today, CAST(sum(price * quantity) AS DOUBLE) AS revenue_today,
               round(CAST(sum(price * quantity) AS DOUBLE) / count(*), 6) AS avg_order_value,
               count(DISTINCT customer_id) AS unique_customers
        FROM live_orders WHERE CAST(timestamp AS DATE) = (SELECT max(CAST(timestamp AS DATE)) FROM live_orders)""",
    "t_recent_orders": """
        SELECT order_id, timestamp, product_id, quantity, CAST(price AS DOUBLE) AS price, payment_method, order_source
        FROM live_orders ORDER BY timestamp DESC, order_id DESC LIMIT 10""",
    "o_run_log": "SELECT * FROM runs",
    "o_run_metrics": f"""
        SELECT 1 AS run_id, metric_name, metric_value FROM (
            SELECT CAST(sum(copies) - count(*) AS DOUBLE) AS duplicates_removed,
                   CAST(count(*) FILTER (discount_was_null) AS DOUBLE) AS nulls_fixed,
                   CAST((SELECT count(*) FROM cleaned WHERE is_anomaly) AS DOUBLE) AS anomalies_flagged,
                   round(CAST(count(*) FILTER ({_KEPT}) AS DOUBLE) * 100.0 / CAST(sum(copies) AS DOUBLE), 2) / 100
                       AS data_quality_score
            FROM staged) UNPIVOT (metric_value FOR metric_name IN (duplicates_removed, nulls_fixed, anomalies_flagged,
                data_quality_score))""",
    "o_quarantine_rate": """
        SELECT count(*) AS issue_count, count(*) > 100 AS is_high FROM quarantine_log
        WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 2880 MINUTE""",
    "o_retention": "SELECT * FROM runs WHERE start_time >= TIMESTAMP '2001-07-01' - INTERVAL 90 DAY",
    "o_quarantine_retention": "SELECT * FROM quarantine_log WHERE timestamp >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY",
    "o_retention_parts": """
        SELECT strftime(date_trunc('week', timestamp), '%Y-%m-%d') AS week, count(*) AS rows_before,
               CASE count(*) FILTER (timestamp < TIMESTAMP '2024-02-10' - INTERVAL 30 DAY) WHEN 0 THEN 'kept' WHEN count(*) THEN 'dropped'
                    ELSE 'rewritten' END AS state
        FROM quarantine_log GROUP BY 1""",
    "o_run_history": """
        SELECT run_id, start_time, status, rows_processed, rows_quarantined, duration_seconds FROM runs
        ORDER BY run_id DESC LIMIT 50""",
    "o_last_run": """
        SELECT run_id, start_time, status, rows_processed, rows_quarantined, duration_seconds FROM runs
        ORDER BY run_id DESC LIMIT 1""",
    "o_success_rate": """
        SELECT count(*) AS runs, round(avg(CASE status WHEN 'success' THEN 1.0 ELSE 0.0 END) * 100, 1) AS success_rate_pct
        FROM (SELECT * FROM runs ORDER BY run_id DESC LIMIT 50)""",
    "o_revenue_flat": """
        SELECT CAST(sum(revenue) AS DOUBLE) AS revenue, count(*) AS row_count FROM fact_sales WHERE date_key = 19980302""",
    "o_revenue_partitioned": """
        SELECT CAST(sum(revenue) AS DOUBLE) AS revenue, count(*) AS row_count FROM fact_sales WHERE date_key = 19980302""",
    "w_partition_roundtrip": """
        SELECT sale_id, date_key, CAST(revenue AS DOUBLE) AS revenue, strftime(date, '%Y-%m') AS date_partition, region
        FROM fact_sales JOIN dim_date USING (date_key) JOIN dim_store USING (store_key)""",
    "w_partition_replaced": """
        SELECT strftime(date, '%Y-%m') AS date_partition, region, count(*) AS sales, CAST(sum(revenue) AS DOUBLE) AS revenue
        FROM fact_sales JOIN dim_date USING (date_key) JOIN dim_store USING (store_key)
        WHERE date_key NOT BETWEEN 19980301 AND 19980331 GROUP BY ALL""",
    "w_quarantine": f"""
        SELECT 'transactions' AS table_name, {_REASON} AS quarantine_reason, count(*) AS row_count
        FROM raw_transactions WHERE {_REASON} <> '' GROUP BY ALL""",
    "s_csv_layouts": """
        SELECT c_custkey, c_name, CASE WHEN c_custkey % 14 <> 7 THEN c_nationkey END AS c_nationkey, c_mktsegment,
               CASE WHEN c_custkey % 14 = 7 THEN concat_ws(',', CAST(c_custkey AS VARCHAR), c_name, 'n/a', c_mktsegment) END AS _corrupt
        FROM customer""",
    "w_samples": """
        SELECT CAST(sale_id AS VARCHAR) AS sale_id, date_key, CAST(revenue AS DOUBLE) AS revenue FROM fact_sales
        ORDER BY date_key, sale_id LIMIT 200""",
    "o_held_steps": """
        SELECT step, status, waiting, loaded, 'transactions' AS table_name, 'approved' AS change_status, 'admin' AS approved_by, 4 AS changes
        FROM (VALUES ('run', 'held', 1, false), ('asked', 'held', 1, false), ('approved', 'success', 0, true)) AS s(step, status, waiting, loaded)""",
    "w_status_updates": """
        SELECT status, count(*) AS runs FROM runs GROUP BY status""",
    "s_csv_ingest": f"""
        SELECT transaction_id, date, store_id, customer_id, product_id, quantity, CAST(price AS DOUBLE) AS price,
               payment_method, CAST(discount AS DOUBLE) AS discount, {_REASON} AS quarantine_reason FROM raw_transactions""",
    "s_inventory_relabel": "SELECT store_id, product_id, date, stock_level FROM raw_inventory",
    "s_snapshots": "SELECT customer_id, name, email, phone, city, snapshot_ts FROM snapshots",
}


def oracle_sql() -> dict[str, str]:
    found = {name: _with_tables(sql, TABLES) for name, sql in FINAL.items()}
    # A batch run rejects rows without a required value before it looks for copies.
    required = " AND ".join(f"{c} IS NOT NULL" for c in ("transaction_id", "product_id", "store_id", "date", "quantity", "price"))
    accepted = f"SELECT * FROM ({TABLES['raw_transactions']}) WHERE {required}"
    found["o_batch_flow"] = _with_tables(FINAL["d_fact_sales"], {**TABLES, "raw_transactions": accepted})
    found["o_held_batch"] = found["o_batch_flow"]
    return found


def _with_tables(final: str, tables: dict[str, str]) -> str:
    """Prefix a query with the common tables it needs, in dependency order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, body in tables.items():
            if name not in needed and re.search(rf"\b{name}\b", sql) and body is not sql:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(final)
    if not needed:
        return final
    return "WITH " + ",\n".join(f"{name} AS ({tables[name]})" for name in needed) + "\n" + final
