"""DuckDB building blocks for the oracle SQL.

The adapter CTEs mirror ``strata.sources.adapters`` and the clean profiles
of ``strata.operators.clean`` column for column.  DuckDB divides DECIMALs
in DOUBLE and casts DOUBLE -> DECIMAL from the binary value, so:

* doubles are cast to DECIMAL through VARCHAR (shortest decimal text, the
  way Spark casts them);
* averages and ratios are exact HALF_UP integer arithmetic on HUGEINT.
"""

from __future__ import annotations


def dec(x: str, p: int = 18, s: int = 2) -> str:
    return f"CAST({x} AS DECIMAL({p},{s}))"


def dbl2dec(x: str, p: int = 12, s: int = 2) -> str:
    return f"CAST(CAST({x} AS VARCHAR) AS DECIMAL({p},{s}))"


def money(x: str, s: int = 2) -> str:
    return f"CAST(round({x}, {s}) AS DECIMAL(38,{s}))"


def div(num: str, den: str, scale: int = 2, ns: int = 2, ds: int = 0, factor: int = 1,
        in_round: int | None = None) -> str:
    """Exact HALF_UP ``round(num * factor / den, scale)``; NULL if den is 0/NULL.

    ``ns`` / ``ds`` must be at least the number of fractional digits of the
    numerator / denominator so that scaling them to integers is exact.
    """
    n = f"CAST(({num}) * {10 ** ns} AS HUGEINT)"
    d = f"CAST(({den}) * {10 ** ds} AS HUGEINT)"
    big_n = f"({n} * {factor * 10 ** (ds + scale)})"
    big_d = f"NULLIF({d} * {10 ** ns}, 0)"
    r = f"(sign({big_n}) * sign({big_d}) * ((2 * abs({big_n}) + abs({big_d})) // (2 * abs({big_d}))))"
    unit = "1" if scale == 0 else "0." + "0" * (scale - 1) + "1"
    return f"CAST(CAST({r} AS DECIMAL(30,0)) * {unit} AS DECIMAL(18,{scale}))"


def avg(x: str, scale: int = 2, xs: int = 2) -> str:
    """Exact HALF_UP mean of a DECIMAL / integer column with ``xs`` decimals."""
    return div(f"sum({x})", f"count({x})", scale, ns=xs, ds=0)


STATUS_CASE = """CASE lower(trim({c}))
    WHEN '完了' THEN 'completed' WHEN '発送済み' THEN 'shipped' WHEN '処理中' THEN 'processing'
    WHEN 'キャンセル' THEN 'cancelled' WHEN '配送完了' THEN 'delivered'
    ELSE lower(trim({c})) END"""


def status(c: str) -> str:
    return STATUS_CASE.format(c=c)


BASE = {
    "customers_raw": """
SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, 'Customer' AS first_name,
       substr(c.c_name, 10) AS last_name, lower(c.c_name) || '@example.com' AS email,
       CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE '555-' || CAST(c.c_custkey AS VARCHAR) END AS phone,
       'Street ' || CAST(c.c_custkey AS VARCHAR) AS address,
       n.n_name AS city, r.r_name AS state, lpad(CAST(c.c_custkey % 100000 AS VARCHAR), 5, '0') AS zip_code,
       n.n_name AS country, r.r_name AS region,
       DATE '1995-01-01' + CAST(c.c_custkey % 365 AS INTEGER) AS registration_date,
       CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(c.c_custkey % 30 AS INTEGER) END AS last_login,
       c.c_mktsegment AS customer_segment,
       '000-00-' || lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0') AS sensitive_ssn
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
                LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "orders_raw": f"""
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' WHEN 'P' THEN 'cancelled' END AS order_status,
       o_orderpriority AS payment_method,
       {dbl2dec('o_totalprice')} AS total_amount,
       CAST(o_custkey % 50 AS DECIMAL(12,2)) AS discount_amount,
       CAST(o_orderkey % 100 AS DECIMAL(12,2)) AS tax_amount,
       CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 5 AS DECIMAL(12,2)) AS shipping_cost,
       CASE o_custkey % 3 WHEN 0 THEN 'JPY' WHEN 1 THEN 'USD' WHEN 2 THEN 'CNY' END AS currency
FROM orders""",
    "order_items_raw": f"""
SELECT order_item_id, order_id, product_id, supplier_id, quantity, total_price, discount,
       CAST(total_price * discount AS DECIMAL(18,6)) AS discount_applied, tax, return_flag, item_status, ship_date
FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS order_item_id,
             l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS supplier_id,
             CAST(trunc(l_quantity) AS BIGINT) AS quantity,
             {dbl2dec('l_extendedprice')} AS total_price,
             {dbl2dec('l_discount', 5, 4)} AS discount,
             {dbl2dec('l_tax', 5, 4)} AS tax,
             l_returnflag AS return_flag,
             CASE l_linestatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'delivered' END AS item_status,
             CAST(l_shipdate AS DATE) AS ship_date
      FROM lineitem) li""",
    "products_raw": f"""
SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, substr(p_name, 1, 3) AS subcategory,
       p_brand AS brand, {dbl2dec('p_retailprice', 10, 2)} AS price,
       CAST({dbl2dec('p_retailprice', 10, 2)} - p_size AS DECIMAL(10,2)) AS cost,
       'SUP-' || CAST(p_partkey % 10 AS VARCHAR) AS supplier, CAST(NULL AS DATE) AS launch_date,
       p_size AS stock_quantity, 20 AS min_stock_level
FROM part""",
    # ---- clean profile "a"
    "customers_a": """
SELECT * REPLACE (lower(trim(email)) AS email, upper(trim(customer_segment)) AS customer_segment)
FROM customers_raw WHERE customer_id IS NOT NULL""",
    "orders_a": f"""
SELECT *, CAST(year(order_date) AS INTEGER) AS order_year, CAST(month(order_date) AS INTEGER) AS order_month,
       CAST(day(order_date) AS INTEGER) AS order_day, strftime(order_date, '%Y-%m') AS order_period
FROM (SELECT * REPLACE ({status('order_status')} AS order_status, lower(trim(payment_method)) AS payment_method,
                        upper(trim(currency)) AS currency)
      FROM orders_raw WHERE order_id IS NOT NULL AND customer_id IS NOT NULL) o""",
    "order_items_a": f"""
SELECT * REPLACE ({status('item_status')} AS item_status)
FROM order_items_raw WHERE order_id IS NOT NULL AND product_id IS NOT NULL AND quantity > 0""",
    "products_a": """
SELECT * REPLACE (trim(category) AS category, trim(subcategory) AS subcategory, trim(brand) AS brand)
FROM products_raw WHERE product_id IS NOT NULL""",
    # ---- clean profile "b"
    "customers_b": """
SELECT * REPLACE (upper(trim(customer_name)) AS customer_name, lower(trim(email)) AS email, trim(phone) AS phone,
                  trim(address) AS address, trim(city) AS city, trim(state) AS state, trim(country) AS country,
                  trim(customer_segment) AS customer_segment)
FROM (SELECT DISTINCT * FROM customers_raw) c WHERE customer_id IS NOT NULL""",
    "orders_b": f"""
SELECT * REPLACE ({status('order_status')} AS order_status)
FROM (SELECT DISTINCT * FROM orders_raw) o
WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND total_amount > 0""",
    "order_items_b": """
SELECT *, CAST(quantity * unit_price * (1 - discount) AS DECIMAL(38,6)) AS line_total
FROM (SELECT DISTINCT i.*, p.price AS unit_price
      FROM order_items_raw i LEFT JOIN products_raw p ON i.product_id = p.product_id) x
WHERE order_id IS NOT NULL AND product_id IS NOT NULL AND quantity > 0 AND unit_price > 0""",
    "products_b": """
SELECT * REPLACE (trim(product_name) AS product_name, trim(category) AS category, trim(subcategory) AS subcategory,
                  trim(supplier) AS supplier)
FROM (SELECT DISTINCT * FROM products_raw) p WHERE product_id IS NOT NULL AND price > 0""",
}


def with_base(body: str, extra: str = "") -> str:
    """Prefix ``body`` with the adapter CTEs and optional extra CTE text
    (``name AS (...), name2 AS (...)``)."""
    text = "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in BASE.items())
    if extra.strip():
        text += ",\n" + extra.strip().strip(",")
    return text + "\n" + body
