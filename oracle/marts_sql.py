"""Oracle SQL for the marts."""

from __future__ import annotations

from oracle.sqlkit import avg, dec, div, money

M1_ORDER = f"""
items_v AS (SELECT * FROM order_items_a WHERE product_id IN (SELECT product_id FROM products_a)),
per_order AS (SELECT order_id, sum(quantity) AS n_items FROM items_v GROUP BY order_id),
od AS (SELECT o.*, p.n_items FROM orders_a o JOIN per_order p USING (order_id)),
summary AS (
  SELECT customer_id, count(*) AS total_orders, {money('sum(total_amount)')} AS total_spent,
         {avg('total_amount')} AS avg_order_value,
         max(order_date) AS last_order_date, min(order_date) AS first_order_date,
         count(CASE WHEN order_status = 'completed' THEN 1 END) AS completed_orders,
         count(CASE WHEN order_status = 'cancelled' THEN 1 END) AS cancelled_orders,
         CAST(sum(n_items) AS BIGINT) AS total_items_purchased,
         {div('sum(n_items)', 'count(*)', 1, ns=0)} AS avg_items_per_order
  FROM od GROUP BY customer_id)"""

M1_ITEM = f"""
od AS (SELECT o.*, i.quantity FROM orders_a o JOIN order_items_a i USING (order_id)
       JOIN (SELECT product_id FROM products_a) p USING (product_id)),
summary AS (
  SELECT customer_id, count(order_id) AS total_orders, {money('sum(total_amount)')} AS total_spent,
         {avg('total_amount')} AS avg_order_value,
         max(order_date) AS last_order_date, min(order_date) AS first_order_date,
         count(CASE WHEN order_status = 'completed' THEN 1 END) AS completed_orders,
         count(CASE WHEN order_status = 'cancelled' THEN 1 END) AS cancelled_orders,
         CAST(sum(quantity) AS BIGINT) AS total_items_purchased,
         {avg('quantity', 1, 0)} AS avg_items_per_order
  FROM od GROUP BY customer_id)"""

M1_SELECT = """
SELECT c.customer_id, c.first_name, c.last_name, c.email, c.country, c.customer_segment, c.registration_date,
       CAST(coalesce(s.total_orders, 0) AS BIGINT) AS total_orders,
       CAST(coalesce(s.total_spent, 0) AS DECIMAL(18,2)) AS total_spent,
       CAST(coalesce(s.avg_order_value, 0) AS DECIMAL(18,2)) AS avg_order_value,
       s.last_order_date, s.first_order_date,
       CAST(coalesce(s.completed_orders, 0) AS BIGINT) AS completed_orders,
       CAST(coalesce(s.cancelled_orders, 0) AS BIGINT) AS cancelled_orders,
       CAST(coalesce(s.total_items_purchased, 0) AS BIGINT) AS total_items_purchased,
       CAST(coalesce(s.avg_items_per_order, 0) AS DECIMAL(18,1)) AS avg_items_per_order
FROM customers_a c LEFT JOIN summary s USING (customer_id)"""

M2_ORDER = f"""
live AS (SELECT order_id, customer_id FROM orders_a WHERE order_status <> 'cancelled'),
per_pc AS (SELECT i.product_id, l.customer_id, sum(i.quantity) AS q, sum(i.total_price) AS rev,
                  sum(i.discount_applied) AS disc, count(DISTINCT i.order_id) AS n_orders
           FROM order_items_a i JOIN live l USING (order_id) GROUP BY i.product_id, l.customer_id),
per_p AS (SELECT product_id, CAST(sum(q) AS BIGINT) AS total_quantity_sold, {money('sum(rev)')} AS total_revenue,
                 CAST(sum(n_orders) AS BIGINT) AS total_orders,
                 {div('sum(q)', 'sum(n_orders)', 1, ns=0)} AS avg_quantity_per_order,
                 {money('sum(disc)')} AS total_discounts_given, count(*) AS unique_customers
          FROM per_pc GROUP BY product_id),
m2 AS (SELECT p.product_id, p.product_name, p.category, p.subcategory, p.brand, p.price, s.* EXCLUDE (product_id)
       FROM products_a p JOIN per_p s USING (product_id))"""

M2_ITEM = f"""
live AS (SELECT order_id, customer_id FROM orders_a WHERE order_status <> 'cancelled'),
m2 AS (SELECT p.product_id, p.product_name, p.category, p.subcategory, p.brand, p.price,
              CAST(sum(i.quantity) AS BIGINT) AS total_quantity_sold, {money('sum(i.total_price)')} AS total_revenue,
              count(i.order_id) AS total_orders, {avg('i.quantity', 1, 0)} AS avg_quantity_per_order,
              {money('sum(i.discount_applied)')} AS total_discounts_given, count(l.customer_id) AS unique_customers
       FROM order_items_a i JOIN live l USING (order_id) JOIN products_a p ON i.product_id = p.product_id
       GROUP BY p.product_id, p.product_name, p.category, p.subcategory, p.brand, p.price)"""

M2_SELECT = f"""SELECT *, {div('total_revenue', 'total_quantity_sold', 2, ns=2, ds=0)} AS revenue_per_unit FROM m2"""

M3_ORDER = f"""
per_order3 AS (SELECT order_id, sum(quantity) AS n_items FROM order_items_a GROUP BY order_id),
s3 AS (SELECT o.*, p.n_items FROM orders_a o JOIN per_order3 p USING (order_id) WHERE o.order_status <> 'cancelled'),
m3 AS (SELECT order_year, order_month, currency, count(*) AS total_orders,
              {money('sum(total_amount)')} AS total_revenue, {money('sum(discount_amount)')} AS total_discounts,
              {money('sum(tax_amount)')} AS total_taxes, {money('sum(shipping_cost)')} AS total_shipping,
              {avg('total_amount')} AS avg_order_value, CAST(sum(n_items) AS BIGINT) AS total_items_sold,
              count(DISTINCT customer_id) AS unique_customers
       FROM s3 GROUP BY order_year, order_month, currency)"""

M3_ITEM = f"""
s3 AS (SELECT o.*, i.quantity FROM orders_a o JOIN order_items_a i USING (order_id) WHERE o.order_status <> 'cancelled'),
m3 AS (SELECT order_year, order_month, currency, count(order_id) AS total_orders,
              {money('sum(total_amount)')} AS total_revenue, {money('sum(discount_amount)')} AS total_discounts,
              {money('sum(tax_amount)')} AS total_taxes, {money('sum(shipping_cost)')} AS total_shipping,
              {avg('total_amount')} AS avg_order_value, CAST(sum(quantity) AS BIGINT) AS total_items_sold,
              count(customer_id) AS unique_customers
       FROM s3 GROUP BY order_year, order_month, currency)"""

M3_SELECT = f"SELECT *, {money('total_revenue - total_discounts')} AS net_revenue FROM m3"

M4 = f"""
cos AS (SELECT customer_id, count(order_id) AS total_orders, {money('sum(total_amount)')} AS total_revenue,
               {avg('total_amount', 6)} AS avg_order_value, max(order_date) AS last_order_date,
               min(order_date) AS first_order_date FROM orders_b GROUP BY customer_id),
cps AS (SELECT o.customer_id, CAST(sum(i.quantity) AS BIGINT) AS total_items_purchased,
               count(DISTINCT i.product_id) AS unique_products_purchased
        FROM order_items_b i JOIN orders_b o USING (order_id) GROUP BY o.customer_id)"""

M4_SELECT = """
SELECT c.customer_id, c.customer_name, c.email, c.city, c.state, c.country, c.customer_segment, c.registration_date,
       CAST(coalesce(a.total_orders, 0) AS BIGINT) AS total_orders,
       CAST(coalesce(a.total_revenue, 0) AS DECIMAL(18,2)) AS total_revenue,
       CAST(coalesce(a.avg_order_value, 0) AS DECIMAL(18,6)) AS avg_order_value,
       CAST(coalesce(b.total_items_purchased, 0) AS BIGINT) AS total_items_purchased,
       CAST(coalesce(b.unique_products_purchased, 0) AS BIGINT) AS unique_products_purchased,
       a.last_order_date, a.first_order_date
FROM customers_b c LEFT JOIN cos a USING (customer_id) LEFT JOIN cps b USING (customer_id)"""

M5 = f"""
ps AS (SELECT i.product_id, CAST(sum(i.quantity) AS BIGINT) AS total_quantity_sold, count(i.order_id) AS total_orders,
              CAST(sum(i.line_total) AS DECIMAL(38,6)) AS total_revenue,
              {div('sum(i.unit_price)', 'count(i.unit_price)', 6, ns=2)} AS avg_selling_price,
              count(DISTINCT o.customer_id) AS unique_customers
       FROM order_items_b i JOIN orders_b o USING (order_id) GROUP BY i.product_id),
m5 AS (SELECT p.product_id, p.product_name, p.category, p.subcategory, p.price, p.cost,
              CAST(p.price - p.cost AS DECIMAL(18,2)) AS margin, p.supplier, p.launch_date,
              CAST(coalesce(s.total_quantity_sold, 0) AS BIGINT) AS total_quantity_sold,
              CAST(coalesce(s.total_orders, 0) AS BIGINT) AS total_orders,
              CAST(coalesce(s.total_revenue, 0) AS DECIMAL(38,6)) AS total_revenue,
              CAST(coalesce(s.avg_selling_price, 0) AS DECIMAL(18,6)) AS avg_selling_price,
              CAST(coalesce(s.unique_customers, 0) AS BIGINT) AS unique_customers
       FROM products_b p LEFT JOIN ps s USING (product_id))"""

M6 = f"""
m6 AS (SELECT CAST(year(o.order_date) AS INTEGER) AS year, CAST(month(o.order_date) AS INTEGER) AS month,
              strftime(o.order_date, '%Y-%m') AS year_month, p.category, c.region,
              CAST(sum(i.quantity) AS BIGINT) AS total_quantity,
              CAST(sum(i.line_total) AS DECIMAL(38,6)) AS total_revenue,
              count(*) AS total_transactions,
              {div('sum(i.line_total)', 'count(*)', 6, ns=6)} AS avg_transaction_value
       FROM orders_b o JOIN order_items_b i USING (order_id) JOIN products_b p ON i.product_id = p.product_id
            LEFT JOIN (SELECT customer_id, region FROM customers_b) c ON o.customer_id = c.customer_id
       GROUP BY ALL)"""

M7 = f"""
m7 AS (SELECT c.country, c.state, c.city, c.region, count(DISTINCT c.customer_id) AS unique_customers,
              count(o.order_id) AS total_orders, {money('sum(o.total_amount)')} AS total_revenue,
              {avg('o.total_amount', 6)} AS avg_order_value
       FROM customers_b c JOIN orders_b o USING (customer_id) GROUP BY ALL)"""

M8 = f"""
m4 AS ({M4_SELECT}),
m5x AS (SELECT * FROM m5),
seg AS (SELECT customer_segment, count(*) AS n FROM m4 GROUP BY customer_segment)"""

M8_SELECT = f"""
SELECT count(*) AS total_customers,
       count(CASE WHEN total_orders > 0 THEN 1 END) AS active_customers,
       CAST(coalesce({avg('total_revenue', 6)}, 0) AS DECIMAL(18,6)) AS avg_customer_value,
       (SELECT customer_segment FROM seg ORDER BY n DESC, customer_segment ASC NULLS LAST LIMIT 1) AS top_customer_segment,
       (SELECT count(*) FROM m5x) AS total_products,
       (SELECT count(CASE WHEN total_quantity_sold > 0 THEN 1 END) FROM m5x) AS products_sold,
       (SELECT product_name FROM m5x ORDER BY total_revenue DESC, product_id ASC LIMIT 1) AS top_selling_product,
       CAST(coalesce((SELECT {avg('total_revenue', 6, 6)} FROM m5x), 0) AS DECIMAL(18,6)) AS avg_product_revenue,
       CAST(coalesce((SELECT sum(total_revenue) FROM m6), 0) AS DECIMAL(38,6)) AS total_revenue,
       CAST(coalesce((SELECT sum(total_transactions) FROM m6), 0) AS BIGINT) AS total_transactions,
       CAST(coalesce((SELECT {avg('total_revenue', 6, 6)} FROM m6), 0) AS DECIMAL(18,6)) AS avg_monthly_revenue
FROM m4"""

M9_SELECT = """
SELECT 'customers' AS table_name, count(*) AS row_count FROM customers_a
UNION ALL SELECT 'orders', count(*) FROM orders_a
UNION ALL SELECT 'order_items', count(*) FROM order_items_a
UNION ALL SELECT 'products', count(*) FROM products_a"""


def cross_sell_sql(min_count: int) -> tuple[str, str]:
    ctes = f"""
b AS (SELECT DISTINCT order_id, product_id FROM order_items_a),
cnt AS (SELECT product_id, count(*) AS n FROM b GROUP BY product_id HAVING count(*) >= {min_count}),
fb AS (SELECT * FROM b WHERE product_id IN (SELECT product_id FROM cnt)),
pairs AS (SELECT x.product_id AS product_a, y.product_id AS product_b, count(*) AS pair_count
          FROM fb x JOIN fb y ON x.order_id = y.order_id AND x.product_id < y.product_id
          GROUP BY 1, 2 HAVING count(*) >= {min_count}),
tot AS (SELECT count(DISTINCT order_id) AS n_orders FROM b)"""
    body = f"""
SELECT p.product_a, p.product_b, p.pair_count, a.n AS orders_a, c.n AS orders_b,
       {div('p.pair_count', '(SELECT n_orders FROM tot)', 6, ns=0)} AS support,
       {div('p.pair_count', 'a.n', 6, ns=0)} AS confidence,
       {div('p.pair_count * (SELECT n_orders FROM tot)', 'a.n * c.n', 6, ns=0)} AS lift
FROM pairs p JOIN cnt a ON p.product_a = a.product_id JOIN cnt c ON p.product_b = c.product_id"""
    return ctes, body


COHORT = f"""
cm AS (SELECT DISTINCT customer_id, CAST(year(order_date) * 12 + month(order_date) - 1 AS BIGINT) AS m FROM orders_a),
firsts AS (SELECT customer_id, min(m) AS c FROM cm GROUP BY customer_id),
cells AS (SELECT f.c, cm.m - f.c AS months_since, count(*) AS active_customers
          FROM cm JOIN firsts f USING (customer_id) GROUP BY 1, 2),
sizes AS (SELECT c, active_customers AS cohort_size FROM cells WHERE months_since = 0)"""

COHORT_SELECT = f"""
SELECT printf('%04d-%02d', CAST(floor(x.c / 12) AS INTEGER), CAST(x.c % 12 + 1 AS INTEGER)) AS cohort_month,
       CAST(x.months_since AS INTEGER) AS months_since, s.cohort_size, x.active_customers,
       {div('x.active_customers', 's.cohort_size', 4, ns=0)} AS retention_rate
FROM cells x JOIN sizes s USING (c)"""

INVENTORY = """
SELECT product_id, product_name, stock_quantity, min_stock_level,
       CASE WHEN stock_quantity < min_stock_level THEN 'low' ELSE 'ok' END AS stock_status,
       CAST(greatest(min_stock_level - stock_quantity, 0) AS INTEGER) AS units_to_reorder
FROM products_a"""

SEGMENT_SELECT = f"""
SELECT customer_segment, count(*) AS customer_count,
       count(CASE WHEN total_orders > 0 THEN 1 END) AS active_customers,
       {money('sum(total_spent)')} AS total_spent, {avg('total_spent')} AS avg_spent,
       {avg('total_orders', 2, 0)} AS avg_orders
FROM m1 GROUP BY customer_segment"""
