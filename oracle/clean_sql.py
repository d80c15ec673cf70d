"""Oracle SQL for clean-layer, quality, governance and join keys."""

from __future__ import annotations

EMAIL_RE = r"'^[^\s@]+@[^\s@]+\.[^\s@]+$'"

STANDARDIZE = """
SELECT customer_id, lower(trim(email)) AS email, upper(trim(customer_segment)) AS customer_segment, trim(city) AS city
FROM customers_raw"""

CAST_SCHEMA = """
SELECT TRY_CAST(order_id AS BIGINT) AS order_id, TRY_CAST(product_id AS BIGINT) AS product_id,
       TRY_CAST(quantity AS INTEGER) AS quantity, TRY_CAST(total_price AS DECIMAL(10,2)) AS total_price,
       TRY_CAST(discount AS DECIMAL(5,4)) AS discount
FROM order_items_raw"""

FILTER_VALID = "SELECT order_id, customer_id, order_status, total_amount FROM orders_b"

DEDUPE = "SELECT DISTINCT * FROM order_items_raw"

DATE_PARTS = "SELECT order_id, order_date, order_year, order_month, order_day, order_period FROM orders_a"

NORMALIZE_DATES = """
SELECT order_id, order_date_text,
       coalesce(try_strptime(trim(order_date_text), '%Y-%m-%d %H:%M:%S'),
                try_strptime(trim(order_date_text), '%m/%d/%Y %H:%M'),
                try_strptime(trim(order_date_text), '%b %d %Y %H:%M')) AS order_ts
FROM (SELECT order_id,
             CASE order_id % 3 WHEN 0 THEN strftime(order_date, '%Y-%m-%d %H:%M:%S')
                               WHEN 1 THEN strftime(order_date, '%m/%d/%Y %H:%M')
                               ELSE strftime(order_date, '%b %-d %Y %H:%M') END AS order_date_text
      FROM orders_raw) t"""

LINE_TOTAL = "SELECT order_id, product_id, quantity, unit_price, discount, line_total FROM order_items_b"

FILL_DEFAULTS = """
SELECT c.customer_id, c.customer_segment, CAST(coalesce(p.completed_orders, 0) AS BIGINT) AS completed_orders,
       CAST(coalesce(p.completed_amount, 0) AS DECIMAL(22,2)) AS completed_amount
FROM customers_a c LEFT JOIN (SELECT customer_id, count(*) AS completed_orders, sum(total_amount) AS completed_amount
                              FROM orders_a WHERE order_status = 'completed' GROUP BY customer_id) p USING (customer_id)"""

CANONICAL_STATUS = "SELECT order_status, count(*) AS orders FROM orders_a GROUP BY order_status"

QUARANTINE = f"""
SELECT count(*) AS total_rows,
       count(CASE WHEN customer_id IS NOT NULL AND coalesce(regexp_matches(email, {EMAIL_RE}), false) THEN 1 END) AS valid_rows,
       count(CASE WHEN customer_id IS NULL THEN 1 END) AS null_customer_id,
       count(CASE WHEN NOT coalesce(regexp_matches(email, {EMAIL_RE}), false) THEN 1 END) AS bad_email
FROM customers_raw"""

QUARANTINE_ORDERS = """
SELECT count(*) AS total_rows,
       count(CASE WHEN order_id IS NOT NULL AND customer_id IS NOT NULL AND coalesce(total_amount > 0, false)
                       AND order_date IS NOT NULL THEN 1 END) AS valid_rows,
       count(CASE WHEN order_id IS NULL THEN 1 END) AS null_order_id,
       count(CASE WHEN customer_id IS NULL THEN 1 END) AS null_customer_id,
       count(CASE WHEN NOT coalesce(total_amount > 0, false) THEN 1 END) AS non_positive_amount,
       count(CASE WHEN order_date IS NULL THEN 1 END) AS bad_order_date
FROM orders_raw"""

QUARANTINE_ROWS = """
SELECT customer_id, 'no mail' AS email, 'bad_email' AS violations FROM customers_raw WHERE customer_id % 9 = 0"""

FILL_MISSING = "SELECT customer_id, coalesce(phone, 'unknown') AS phone FROM customers_raw"

RUN_PIPELINE_B = """
SELECT 'customer_analytics_row_count' AS metric, CAST(count(*) AS VARCHAR) AS value FROM m4
UNION ALL SELECT 'product_analytics_row_count', CAST(count(*) AS VARCHAR) FROM m5
UNION ALL SELECT 'monthly_sales_row_count', CAST(count(*) AS VARCHAR) FROM m6
UNION ALL SELECT 'geographic_analytics_row_count', CAST(count(*) AS VARCHAR) FROM m7
UNION ALL SELECT 'marts', '4' UNION ALL SELECT 'tables_processed', '4' UNION ALL SELECT 'success', 'True'"""

EMAIL_RULE = f"""
SELECT customer_id, email, coalesce(regexp_matches(email, {EMAIL_RE}), false) AS email_ok FROM customers_raw"""

_CUST_COLS = ["customer_id", "customer_name", "first_name", "last_name", "email", "phone", "address", "city",
              "state", "zip_code", "country", "region", "registration_date", "last_login", "customer_segment",
              "sensitive_ssn"]

MISSING = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS missing FROM customers_raw"
    for c in _CUST_COLS)

_ORDER_COLS = ["order_id", "customer_id", "order_date", "order_status", "payment_method", "total_amount",
               "discount_amount", "tax_amount", "shipping_cost", "currency", "order_year", "order_month",
               "order_day", "order_period"]

DQ_PROFILE = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, "
    f"count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, "
    f"CAST(max({c}) AS VARCHAR) AS max_value FROM orders_a" for c in _ORDER_COLS)

DQ_REFERENTIAL = """
SELECT 'orders_without_customer' AS check_name, count(*) AS orphan_count FROM orders_a o
  WHERE NOT EXISTS (SELECT 1 FROM customers_a c WHERE c.customer_id = o.customer_id)
UNION ALL SELECT 'items_without_order', count(*) FROM order_items_a i
  WHERE NOT EXISTS (SELECT 1 FROM orders_a o WHERE o.order_id = i.order_id)
UNION ALL SELECT 'items_without_product', count(*) FROM order_items_a i
  WHERE NOT EXISTS (SELECT 1 FROM products_a p WHERE p.product_id = i.product_id)
UNION ALL SELECT 'customers_without_orders', count(*) FROM (SELECT DISTINCT customer_id FROM customers_a) c
  WHERE NOT EXISTS (SELECT 1 FROM orders_a o WHERE o.customer_id = c.customer_id)
UNION ALL SELECT 'products_without_sales', count(*) FROM (SELECT DISTINCT product_id FROM products_a) p
  WHERE NOT EXISTS (SELECT 1 FROM order_items_a i WHERE i.product_id = p.product_id)
UNION ALL SELECT 'orders_without_items', count(*) FROM orders_a o
  WHERE NOT EXISTS (SELECT 1 FROM order_items_a i WHERE i.order_id = o.order_id)"""

_MASK = ("CASE WHEN length(sensitive_ssn) > 4 THEN regexp_replace(substr(sensitive_ssn, 1, length(sensitive_ssn) - 4), '[0-9]', '*', 'g') "
         "|| right(sensitive_ssn, 4) ELSE repeat('*', length(sensitive_ssn)) END")

MASK_COLUMNS = f"SELECT * REPLACE ({_MASK} AS sensitive_ssn, sha256(email) AS email) FROM customers_a"

ROW_FILTER = f"""SELECT * REPLACE ({_MASK} AS sensitive_ssn, sha256(email) AS email) FROM customers_a
WHERE region IN ('EUROPE')"""

TABLE_ACCESS = "SELECT * EXCLUDE (email) FROM m1"

JOIN_ORDERS_ITEMS = """
SELECT o.order_id, o.customer_id, o.order_status, i.order_id AS item_order_id, i.product_id, i.quantity
FROM orders_a o JOIN order_items_a i ON o.order_id = i.order_id"""

JOIN_USING = """
SELECT order_id, o.order_date, i.product_id, i.total_price FROM orders_a o JOIN order_items_a i USING (order_id)"""

STAR_JOIN = """
SELECT i.product_id, i.order_id, i.quantity, o.currency, p.product_name, p.category, p.brand, p.price
FROM order_items_a i JOIN orders_a o USING (order_id) JOIN products_a p ON i.product_id = p.product_id"""

DIM_LEFT_FACT = """
SELECT p.product_id, p.product_name, CAST(coalesce(a.lines, 0) AS BIGINT) AS lines,
       CAST(coalesce(a.units, 0) AS BIGINT) AS units
FROM products_a p LEFT JOIN (SELECT product_id, count(*) AS lines, sum(quantity) AS units FROM order_items_a
                             GROUP BY product_id) a USING (product_id)"""

CUSTOMERS_ORDERS = """
SELECT customer_id, c.country, o.order_id, o.total_amount FROM customers_b c JOIN orders_b o USING (customer_id)"""

BASKET_PAIRS = """
SELECT product_a, product_b, pair_count FROM pairs"""

READ_ANY = "SELECT * FROM orders"

WRITE_MART = "SELECT * FROM m3x"

PARTITION_REPAIR = """
SELECT DISTINCT 'order_year=' || CAST(order_year AS VARCHAR) || '/order_month=' || CAST(order_month AS VARCHAR) AS partition
FROM m3x"""

# Every seventh order's items have a line feed in their status.
_STATUS = "CASE WHEN order_id % 7 = 0 THEN item_status || chr(10) || 'checked' ELSE item_status END"

READ_DECLARED = f"SELECT * REPLACE ({_STATUS} AS item_status) FROM order_items_raw WHERE order_id % 50 != 0"

READ_DECLARED_REJECTS = f"""
SELECT order_item_id, 'does not fit the declared schema' AS reason,
       concat_ws(',', order_item_id, order_id, product_id, supplier_id, 'many', total_price, discount, discount_applied, tax,
                 return_flag, CASE WHEN order_id % 7 = 0 THEN '"' || {_STATUS} || '"' ELSE item_status END, ship_date) AS line
FROM order_items_raw WHERE order_id % 50 = 0"""

READ_CSV = """
SELECT * REPLACE (CAST(zip_code AS INTEGER) AS zip_code, CAST(customer_id AS INTEGER) AS customer_id,
                 CAST(last_name AS INTEGER) AS last_name) FROM customers_raw"""

READ_JSON = "SELECT event_id, ts, user_id, event_type, value, props FROM events"

CREATE_TABLES = "SELECT * FROM (VALUES ('monthly_sales', true, false), ('orders', true, false), ('nowhere', false, true)) t(table_name, success, has_error)"

CRAWL = """
SELECT table_name, column_name, data_type, is_partition, 'new' AS change FROM (VALUES
  ('events', 'event_id', 'bigint', false), ('events', 'event_type', 'string', false), ('events', 'ts', 'timestamp_ntz', false),
  ('monthly_sales', 'currency', 'string', false), ('monthly_sales', 'total_orders', 'bigint', false),
  ('monthly_sales', 'total_revenue', 'decimal(38,2)', false), ('monthly_sales', 'total_discounts', 'decimal(38,2)', false),
  ('monthly_sales', 'total_taxes', 'decimal(38,2)', false), ('monthly_sales', 'total_shipping', 'decimal(38,2)', false),
  ('monthly_sales', 'avg_order_value', 'decimal(18,2)', false), ('monthly_sales', 'total_items_sold', 'bigint', false),
  ('monthly_sales', 'unique_customers', 'bigint', false), ('monthly_sales', 'net_revenue', 'decimal(38,2)', false),
  ('monthly_sales', 'order_year', 'int', true), ('monthly_sales', 'order_month', 'int', true)) t(table_name, column_name, data_type, is_partition)"""

CRAWL_UPDATE = """
SELECT c.*, CASE table_name WHEN 'events' THEN (SELECT 2 * count(*) FROM events) WHEN 'nations' THEN (SELECT count(*) FROM nation) ELSE (SELECT count(*) FROM region) END AS row_count,
       CASE table_name WHEN 'events' THEN (SELECT count(user_id) FROM events) WHEN 'nations' THEN (SELECT count(n_regionkey) FROM nation) ELSE (SELECT count(r_name) FROM region) END AS values_added
FROM (VALUES
  ('events', 'event_id', false, 'same', 'parquet', false), ('events', 'ts', false, 'same', 'parquet', false), ('events', 'user_id', false, 'new', 'parquet', true),
  ('events', 'event_type', true, 'same', 'parquet', false), ('nations', 'n_nationkey', false, 'same', 'csv', false), ('nations', 'n_name', false, 'same', 'csv', false),
  ('nations', 'n_regionkey', false, 'new', 'csv', true), ('regions', 'r_regionkey', false, 'same', 'json', false), ('regions', 'r_name', false, 'same', 'json', false))
  c(table_name, column_name, is_partition, change, format, applied)"""

RUN_PIPELINE = """
SELECT 'customer_analytics_row_count' AS metric, CAST(count(*) AS VARCHAR) AS value FROM m1
UNION ALL SELECT 'product_analytics_row_count', CAST(count(*) AS VARCHAR) FROM m2x
UNION ALL SELECT 'monthly_sales_row_count', CAST(count(*) AS VARCHAR) FROM m3x
UNION ALL SELECT 'marts', '3' UNION ALL SELECT 'tables_processed', '4' UNION ALL SELECT 'success', 'True'"""

STREAM_METRICS = """
SELECT w AS window_start, w + INTERVAL 1 MINUTE AS window_end, name, dimensions, samples, max_value FROM (
  SELECT date_trunc('minute', timestamp) AS w, name, 'user=' || CAST(user_id AS VARCHAR) AS dimensions, count(*) AS samples, max(value) AS max_value
  FROM metrics_t GROUP BY 1, 2, 3)
WHERE w + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(timestamp)) - INTERVAL 2 MINUTE FROM metrics_t)"""

STREAM_SECURITY = """
SELECT h AS hour_start, eventName, event_count FROM (
  SELECT date_trunc('hour', eventTime) AS h, eventName, count(*) AS event_count FROM audit_events
  WHERE eventName IN ({names}) GROUP BY 1, 2)
WHERE h + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(eventTime)) - INTERVAL 10 MINUTE FROM audit_events WHERE eventName IN ({names}))"""

STREAM_REJECTS = """
SELECT order_id, CAST(NULL AS BIGINT) AS customer_id, 'null_customer_id' AS violations FROM orders_raw WHERE order_id % 40 = 0"""

VALIDATE_INPUT = "SELECT count(*) > 0 AS has_rows FROM (SELECT 1 FROM orders LIMIT 1) t"

STREAM_INGEST = f"""
SELECT * REPLACE (CASE lower(trim(order_status)) WHEN 'completed' THEN 'completed' ELSE lower(trim(order_status)) END
                  AS order_status)
FROM orders_raw WHERE order_id % 40 != 0 AND order_id IS NOT NULL AND customer_id IS NOT NULL AND coalesce(total_amount > 0, false)"""

STREAM_EVENT_LOG = """
SELECT event_id, ts, event_type, user_id, value, 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service,
       strftime(ts, '%Y-%m-%d-%H') AS hour FROM events"""

# Written from the events: an error's record has four lines below its first.
READ_LOGS = """
SELECT date_trunc('millisecond', ts) AS log_time, 'user-' || user_id AS logger, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       'event ' || event_id AS message, 0 AS part, CASE WHEN event_type = 'error' THEN 5 ELSE 1 END AS n_lines,
       md5(strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' - user-' || user_id || CASE WHEN event_type = 'error' THEN
           ' - ERROR - event ' || event_id || chr(10) || 'Traceback (most recent call last):' || chr(10) || chr(10) || '  File "job.py", line ' || user_id || chr(10) || 'ValueError: ' || coalesce(props, '-')
           ELSE ' - INFO - event ' || event_id END) AS text_md5
FROM events"""

ROLE_VIEWS = f"""
SELECT 'engineer' AS role, 'customers_raw' AS table_name, customer_id, email, phone, sensitive_ssn, region FROM customers_raw
UNION ALL SELECT 'engineer', t.table_name, customer_id, email, phone, sensitive_ssn, region FROM customers_a, (VALUES ('customers'), ('contacts')) t(table_name)
UNION ALL SELECT 'analyst', t.table_name, customer_id, sha256(email), phone, {_MASK}, region FROM customers_a, (VALUES ('customers'), ('contacts')) t(table_name)
UNION ALL SELECT 'analyst_europe', t.table_name, customer_id, sha256(email), phone, {_MASK}, region FROM customers_a, (VALUES ('customers'), ('contacts')) t(table_name) WHERE region = 'EUROPE'
UNION ALL SELECT 'viewer', 'contacts', customer_id, NULL, NULL, NULL, region FROM customers_a"""

DQ_PROFILE_MERGED = "SELECT column_name, total_rows, null_count, min_value, max_value, true AS distinct_within_error FROM (" + DQ_PROFILE + ") WHERE column_name <> 'order_period'"
