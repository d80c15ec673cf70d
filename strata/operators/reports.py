"""Report queries over the marts (Q1-Q14), top-k (T1-T7), windows (W1) and
set operations (U1, U2).

Every limit carries a unique tie-break key so the rows kept are the same in
any engine.  Top-k is ``orderBy(...).limit(k)``, which Spark plans as
TakeOrderedAndProject: each task keeps its own k best rows and only those
reach the final merge, so no global sort of the input happens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.numeric import avg_exact, div_round, money

# ------------------------------------------------------------------ top-k


def top_k(df: DataFrame, order: list, k: int, cols: list | None = None) -> DataFrame:
    """T4 in general form: first ``k`` rows after sorting by ``order``."""
    out = df.orderBy(*order).limit(k)
    return out.select(*cols) if cols else out


def top_one(df: DataFrame, by: str, key: str, cols: list | None = None) -> DataFrame:
    """T4: the single best row by ``by`` (descending), ties to the lowest ``key``."""
    return top_k(df, [F.desc(by), F.asc(key)], 1, cols)


def top_customers(m1: DataFrame, k: int = 10) -> DataFrame:
    """Customers with spend, by spend descending."""
    return top_k(m1.where(F.col("total_spent") > 0),
                 [F.desc("total_spent"), F.asc("customer_id")], k,
                 ["customer_id", "first_name", "last_name", "country", "customer_segment",
                  "total_spent", "total_orders", "avg_order_value"])


def top_products(m2: DataFrame, k: int = 20) -> DataFrame:
    """Products by revenue descending."""
    return top_k(m2, [F.desc("total_revenue"), F.asc("product_id")], k,
                 ["product_id", "product_name", "brand", "category", "subcategory", "price",
                  "total_quantity_sold", "total_revenue", "total_orders", "unique_customers",
                  "revenue_per_unit"])


def top_profitable(m2: DataFrame, min_revenue: int = 1000, k: int = 15) -> DataFrame:
    """Revenue above a floor, by revenue net of discounts."""
    net = (F.col("total_revenue") - F.col("total_discounts_given")).cast("decimal(18,2)")
    d = m2.where(F.col("total_revenue") > min_revenue).select(
        "product_id", "product_name", "brand", "category", "price", "total_revenue",
        "total_discounts_given", net.alias("net_revenue"),
        div_round("total_discounts_given", "total_revenue", 2, factor=100).alias("discount_percentage"),
        "total_quantity_sold")
    return top_k(d, [F.desc("net_revenue"), F.asc("product_id")], k)


def monthly_trend(m3: DataFrame) -> DataFrame:
    """The monthly mart in period and currency order."""
    return m3.select("order_year", "order_month", "currency", "total_orders", "total_revenue",
                     "total_discounts", "net_revenue", "avg_order_value", "unique_customers"
                     ).orderBy("order_year", "order_month", "currency")


def sample_rows(df: DataFrame, order_by: list, n: int = 10) -> DataFrame:
    """Q14: the first ``n`` rows of a mart in a stated order."""
    return top_k(df, order_by, n)


def newest(df: DataFrame, ts: str, k: int = 100, key: str | None = None) -> DataFrame:
    """The newest ``k`` rows by a timestamp (ties to the lowest ``key``)."""
    order = [F.desc(ts)] + ([F.asc(key)] if key else [])
    return top_k(df, order, k)


# ------------------------------------------------------------------ rollups


def segment_country(m1: DataFrame) -> DataFrame:
    """Q2: segment x country over customers with spend."""
    return (m1.where(F.col("total_spent") > 0).groupBy("customer_segment", "country").agg(
        F.count(F.lit(1)).alias("customer_count"),
        avg_exact("total_spent").alias("avg_total_spent"),
        avg_exact("total_orders").alias("avg_total_orders"),
        avg_exact("avg_order_value").alias("avg_order_value"),
        money(F.sum("total_spent")).alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "customer_segment", "country"))


def customer_type(total_orders) -> F.Column:
    c = F.col(total_orders) if isinstance(total_orders, str) else total_orders
    return (F.when(c == 1, F.lit("One-time Customer"))
            .when(c.between(2, 5), F.lit("Regular Customer"))
            .when(c > 5, F.lit("Loyal Customer")))


def retention_type(m1: DataFrame) -> DataFrame:
    """Q3: one-time (1 order) / regular (2-5) / loyal (>5) customers."""
    return (m1.where(F.col("total_spent") > 0)
            .groupBy(customer_type("total_orders").alias("customer_type")).agg(
                F.count(F.lit(1)).alias("customer_count"),
                avg_exact("total_spent").alias("avg_total_spent"),
                money(F.sum("total_spent")).alias("total_revenue"))
            .orderBy(F.desc("total_revenue")))


def category_performance(m2: DataFrame) -> DataFrame:
    """Q5: per category.  ``total_unique_customers`` is a sum of per-product
    distinct counts, so one person can count more than once."""
    return (m2.groupBy("category").agg(
        F.count(F.lit(1)).alias("product_count"),
        F.sum("total_quantity_sold").alias("total_quantity_sold"),
        money(F.sum("total_revenue")).alias("total_category_revenue"),
        avg_exact("price").alias("avg_product_price"),
        F.sum("unique_customers").alias("total_unique_customers"))
        .orderBy(F.desc("total_category_revenue"), "category"))


def brand_performance(m2: DataFrame) -> DataFrame:
    """Q6: per brand."""
    return (m2.groupBy("brand").agg(
        F.count(F.lit(1)).alias("product_count"),
        money(F.sum("total_revenue")).alias("total_brand_revenue"),
        avg_exact("price").alias("avg_product_price"),
        F.sum("total_quantity_sold").alias("total_quantity_sold"),
        avg_exact("revenue_per_unit").alias("avg_revenue_per_unit"))
        .orderBy(F.desc("total_brand_revenue"), "brand"))


def currency_performance(m3: DataFrame) -> DataFrame:
    """Q10: per currency (``total_customers`` sums monthly distinct counts)."""
    return (m3.groupBy("currency").agg(
        money(F.sum("total_revenue")).alias("total_revenue"),
        F.sum("total_orders").alias("total_orders"),
        avg_exact("avg_order_value").alias("avg_order_value"),
        F.sum("unique_customers").alias("total_customers"))
        .orderBy(F.desc("total_revenue")))


def lifetime_value(m1: DataFrame) -> DataFrame:
    """Q11: repeat customers' value, lifespan and annualised value."""
    cm = m1.where((F.col("total_orders") > 1) & F.col("first_order_date").isNotNull()
                  & F.col("last_order_date").isNotNull()).select(
        "customer_segment", "country", "total_spent", "total_orders",
        F.datediff("last_order_date", "first_order_date").alias("customer_lifespan_days"))
    annual = div_round("total_spent", "customer_lifespan_days", 6, factor=365)
    return (cm.withColumn("annual", annual).groupBy("customer_segment", "country").agg(
        F.count(F.lit(1)).alias("customer_count"),
        avg_exact("total_spent").alias("avg_lifetime_value"),
        avg_exact("customer_lifespan_days").alias("avg_lifespan_days"),
        avg_exact("annual").alias("estimated_annual_value"))
        .orderBy(F.desc("avg_lifetime_value"), "customer_segment", "country"))


# ------------------------------------------------------------------ W1


def yoy_growth(m3: DataFrame) -> DataFrame:
    """Monthly totals against the previous available year.

    The window partitions by calendar month over an already aggregated table
    (one row per year and month), so each partition is tiny.
    """
    mt = m3.groupBy("order_year", "order_month").agg(
        money(F.sum("total_revenue")).alias("monthly_revenue"),
        F.sum("total_orders").alias("monthly_orders"))
    prev = F.lag("monthly_revenue").over(Window.partitionBy("order_month").orderBy("order_year"))
    out = mt.withColumn("prev_year_revenue", prev)
    growth = div_round(F.col("monthly_revenue") - F.col("prev_year_revenue"), "prev_year_revenue", 2,
                       factor=100)
    return (out.withColumn("yoy_growth_percentage",
                           F.when(F.col("prev_year_revenue").isNotNull(), growth))
            .orderBy("order_year", "order_month"))


# ------------------------------------------------------------------ U1 / U2


def completeness_check(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """Totals, non-null counts and averages of two marts."""
    a = m1.agg(F.lit("customer_analytics").alias("table_name"),
               F.count(F.lit(1)).alias("total_records"),
               F.count("customer_id").alias("non_null_key"),
               F.count("total_spent").alias("non_null_measure"),
               avg_exact("total_spent").alias("avg_measure"))
    b = m2.agg(F.lit("product_analytics").alias("table_name"),
               F.count(F.lit(1)).alias("total_records"),
               F.count("product_id").alias("non_null_key"),
               F.count("total_revenue").alias("non_null_measure"),
               avg_exact("total_revenue").alias("avg_measure"))
    return a.unionByName(b)


def _period(year, month) -> F.Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def freshness_check(m1: DataFrame, m3: DataFrame, literal: bool = False) -> DataFrame:
    """Newest and oldest date / period of two marts, as text.

    Default: the newest period is ``max(struct(year, month))``, a period that
    exists.  ``literal=True`` takes max(year) and max(month) apart, as the
    original query did, which can name a period with no data.
    """
    a = m1.agg(F.lit("customer_analytics").alias("table_name"),
               F.max("last_order_date").cast("string").alias("latest"),
               F.min("first_order_date").cast("string").alias("earliest"))
    if literal:
        b = m3.agg(F.lit("monthly_sales").alias("table_name"),
                   F.concat(F.max("order_year").cast("string"), F.lit("-"),
                            F.max("order_month").cast("string")).alias("latest"),
                   F.concat(F.min("order_year").cast("string"), F.lit("-"),
                            F.min("order_month").cast("string")).alias("earliest"))
    else:
        hi = F.max(F.struct("order_year", "order_month"))
        lo = F.min(F.struct("order_year", "order_month"))
        b = m3.agg(F.lit("monthly_sales").alias("table_name"),
                   _period(hi["order_year"], hi["order_month"]).alias("latest"),
                   _period(lo["order_year"], lo["order_month"]).alias("earliest"))
    return a.unionByName(b)
