"""Analytics marts.

Grain.  The first mart family can be computed at two grains:

* ``grain="order"`` (default): item rows are pre-aggregated per order first,
  then order-header amounts are summed once per order and distinct counts
  are real distinct counts.
* ``grain="item"``: the literal definition, where order headers are joined
  to item rows before summing, so header amounts count once per item and
  "orders" / "unique customers" count item rows.

Shape of every plan: aggregate the large side on its join key before the
join (partial aggregation combines hot keys map-side), join aggregated rows
1:1, then group on the report key.  Distinct counts are written as a chain
of group-bys ((k, x) then k) instead of several ``countDistinct`` in one
aggregate, so Spark does not need its Expand rewrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.joins import basket, dealt, pair_tasks, pairs_of, tasks_for
from strata.functions.numeric import avg_exact, div_round, money
from strata.operators.clean import fill_measures

COMPLETED, CANCELLED = "completed", "cancelled"


def _not_cancelled(orders: DataFrame) -> DataFrame:
    # `!=` also drops NULL status, as the mart definition does.
    return orders.where(F.col("order_status") != F.lit(CANCELLED))


# ------------------------------------------------------------------ M1

CUSTOMER_COLS = ["customer_id", "first_name", "last_name", "email", "country",
                 "customer_segment", "registration_date"]
M1_MEASURES = ["total_orders", "total_spent", "avg_order_value", "completed_orders",
               "cancelled_orders", "total_items_purchased", "avg_items_per_order"]


def customer_analytics(T: dict, grain: str = "order") -> DataFrame:
    """M1: one row per customer, customers without orders padded with 0."""
    o, i, p = T["orders"], T["order_items"], T["products"]
    if grain == "order":
        items = i.join(p.select("product_id"), "product_id", "left_semi")
        per_order = items.groupBy("order_id").agg(F.sum("quantity").alias("n_items"))
        od = o.join(per_order, "order_id")
        summary = od.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("total_orders"),
            money(F.sum("total_amount")).alias("total_spent"),
            avg_exact("total_amount").alias("avg_order_value"),
            F.max("order_date").alias("last_order_date"),
            F.min("order_date").alias("first_order_date"),
            F.count(F.when(F.col("order_status") == COMPLETED, 1)).alias("completed_orders"),
            F.count(F.when(F.col("order_status") == CANCELLED, 1)).alias("cancelled_orders"),
            F.sum("n_items").alias("total_items_purchased"),
            div_round(F.sum("n_items"), F.count(F.lit(1)), 1).alias("avg_items_per_order"),
        )
    elif grain == "item":
        od = o.join(i, "order_id").join(p.select("product_id"), "product_id")
        summary = od.groupBy("customer_id").agg(
            F.count("order_id").alias("total_orders"),
            money(F.sum("total_amount")).alias("total_spent"),
            avg_exact("total_amount").alias("avg_order_value"),
            F.max("order_date").alias("last_order_date"),
            F.min("order_date").alias("first_order_date"),
            F.count(F.when(F.col("order_status") == COMPLETED, 1)).alias("completed_orders"),
            F.count(F.when(F.col("order_status") == CANCELLED, 1)).alias("cancelled_orders"),
            F.sum("quantity").alias("total_items_purchased"),
            avg_exact("quantity", 1).alias("avg_items_per_order"),
        )
    else:
        raise ValueError(f"grain must be 'order' or 'item', not {grain!r}")
    out = T["customers"].select(*CUSTOMER_COLS).join(summary, "customer_id", "left").select(
        *CUSTOMER_COLS, "total_orders", "total_spent", "avg_order_value", "last_order_date",
        "first_order_date", "completed_orders", "cancelled_orders", "total_items_purchased",
        "avg_items_per_order")
    return fill_measures(out, M1_MEASURES)


# ------------------------------------------------------------------ M2

PRODUCT_KEYS = ["product_id", "product_name", "category", "subcategory", "brand", "price"]


def product_analytics(T: dict, grain: str = "order") -> DataFrame:
    """M2: per sold product (cancelled orders excluded)."""
    o, i, p = T["orders"], T["order_items"], T["products"]
    live = _not_cancelled(o).select("order_id", "customer_id")
    if grain == "order":
        # The join on the order brings an order's lines together: the lines of
        # a product in it are added up without another shuffle.  Both shuffles
        # go to tasks in proportion to the lines (counted before), so that a
        # task's sorts and hash tables stay the same when there are more.
        lines = i.select("order_id", "product_id", "quantity", "total_price", "discount_applied")
        n = tasks_for(lines.sparkSession, lines.count())
        per_po = dealt(lines, n, "order_id").join(dealt(live, n, "order_id"), "order_id").groupBy(
            "order_id", "product_id", "customer_id").agg(
            F.sum("quantity").alias("q"), F.sum("total_price").alias("rev"),
            F.sum("discount_applied").alias("disc"))
        per_pc = dealt(per_po, n, "product_id", "customer_id").groupBy("product_id", "customer_id").agg(
            F.sum("q").alias("q"), F.sum("rev").alias("rev"), F.sum("disc").alias("disc"),
            F.count(F.lit(1)).alias("n_orders"))
        per_p = per_pc.groupBy("product_id").agg(
            F.sum("q").alias("total_quantity_sold"),
            money(F.sum("rev")).alias("total_revenue"),
            F.sum("n_orders").alias("total_orders"),
            div_round(F.sum("q"), F.sum("n_orders"), 1).alias("avg_quantity_per_order"),
            money(F.sum("disc")).alias("total_discounts_given"),
            F.count(F.lit(1)).alias("unique_customers"))
        out = p.select(*PRODUCT_KEYS).join(per_p, "product_id")
    elif grain == "item":
        s = i.join(live, "order_id").join(p.select(*PRODUCT_KEYS), "product_id")
        out = s.groupBy(*PRODUCT_KEYS).agg(
            F.sum("quantity").alias("total_quantity_sold"),
            money(F.sum("total_price")).alias("total_revenue"),
            F.count("order_id").alias("total_orders"),
            avg_exact("quantity", 1).alias("avg_quantity_per_order"),
            money(F.sum("discount_applied")).alias("total_discounts_given"),
            F.count("customer_id").alias("unique_customers"))
    else:
        raise ValueError(f"grain must be 'order' or 'item', not {grain!r}")
    return out.withColumn("revenue_per_unit",
                          div_round("total_revenue", "total_quantity_sold", 2))


# ------------------------------------------------------------------ M3

def monthly_sales(T: dict, grain: str = "order") -> DataFrame:
    """M3: per (order_year, order_month, currency), cancelled excluded."""
    o, i = _not_cancelled(T["orders"]), T["order_items"]
    keys = ["order_year", "order_month", "currency"]
    if grain == "order":
        per_order = i.groupBy("order_id").agg(F.sum("quantity").alias("n_items"))
        s = o.join(per_order, "order_id")
        orders_col, items_col = F.count(F.lit(1)), F.sum("n_items")
        cust = F.countDistinct("customer_id")
    elif grain == "item":
        s = o.join(i, "order_id")
        orders_col, items_col = F.count("order_id"), F.sum("quantity")
        cust = F.count("customer_id")
    else:
        raise ValueError(f"grain must be 'order' or 'item', not {grain!r}")
    out = s.groupBy(*keys).agg(
        orders_col.alias("total_orders"),
        money(F.sum("total_amount")).alias("total_revenue"),
        money(F.sum("discount_amount")).alias("total_discounts"),
        money(F.sum("tax_amount")).alias("total_taxes"),
        money(F.sum("shipping_cost")).alias("total_shipping"),
        avg_exact("total_amount").alias("avg_order_value"),
        items_col.alias("total_items_sold"),
        cust.alias("unique_customers"))
    return out.withColumn("net_revenue", money(F.col("total_revenue") - F.col("total_discounts")))


# ------------------------------------------------------------------ M4-M7 (profile "b" tables)

def customer_profile(T: dict, grain: str = "order") -> DataFrame:
    """M4: order figures straight from orders (no fan-out), item figures from
    items joined to orders; customers without orders get 0."""
    c, o, i = T["customers"], T["orders"], T["order_items"]
    cos = o.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        money(F.sum("total_amount")).alias("total_revenue"),
        avg_exact("total_amount", 6).alias("avg_order_value"),
        F.max("order_date").alias("last_order_date"),
        F.min("order_date").alias("first_order_date"))
    oc = o.select("order_id", "customer_id")
    if grain == "order":
        per_cp = i.join(oc, "order_id").groupBy("customer_id", "product_id").agg(F.sum("quantity").alias("q"))
        cps = per_cp.groupBy("customer_id").agg(
            F.sum("q").alias("total_items_purchased"),
            F.count(F.lit(1)).alias("unique_products_purchased"))
    else:
        cps = i.join(oc, "order_id").groupBy("customer_id").agg(
            F.sum("quantity").alias("total_items_purchased"),
            F.count("product_id").alias("unique_products_purchased"))
    out = (c.join(cos, "customer_id", "left").join(cps, "customer_id", "left")
           .select("customer_id", "customer_name", "email", "city", "state", "country",
                   "customer_segment", "registration_date", "total_orders", "total_revenue",
                   "avg_order_value", "total_items_purchased", "unique_products_purchased",
                   "last_order_date", "first_order_date"))
    return fill_measures(out, ["total_orders", "total_revenue", "avg_order_value",
                               "total_items_purchased", "unique_products_purchased"])


def product_profile(T: dict) -> DataFrame:
    """M5: per product (all products, unsold padded with 0)."""
    p, o, i = T["products"], T["orders"], T["order_items"]
    s = i.join(o.select("order_id", "customer_id"), "order_id")
    per_pc = s.groupBy("product_id", "customer_id").agg(
        F.sum("quantity").alias("q"), F.count("order_id").alias("lines"),
        F.sum("line_total").alias("rev"), F.sum("unit_price").alias("up_sum"),
        F.count("unit_price").alias("up_n"))
    ps = per_pc.groupBy("product_id").agg(
        F.sum("q").alias("total_quantity_sold"),
        F.sum("lines").alias("total_orders"),
        F.sum("rev").cast("decimal(38,6)").alias("total_revenue"),
        div_round(F.sum("up_sum"), F.sum("up_n"), 6).alias("avg_selling_price"),
        F.count(F.lit(1)).alias("unique_customers"))
    out = p.join(ps, "product_id", "left").select(
        "product_id", "product_name", "category", "subcategory", "price", "cost",
        (F.col("price") - F.col("cost")).cast("decimal(18,2)").alias("margin"),
        "supplier", "launch_date", "total_quantity_sold", "total_orders", "total_revenue",
        "avg_selling_price", "unique_customers")
    return fill_measures(out, ["total_quantity_sold", "total_orders", "total_revenue",
                               "avg_selling_price", "unique_customers"])


def orders_with_region(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """J5 enrichment: the region of the ordering customer."""
    return orders.join(customers.select("customer_id", "region"), "customer_id", "left")


def monthly_category_sales(T: dict) -> DataFrame:
    """M6: per (year, month, yyyy-MM, category, region), sorted.

    Lines meet their orders as they are, before the products: few lines of an
    order share a category, so reducing them first would cost a shuffle and save
    few rows, and lines that are kept by order need none.  The sums are begun
    where the last join is.
    """
    p, o, i, c = T["products"], T["orders"], T["order_items"], T["customers"]
    od = orders_with_region(o, c).select("order_id", "order_date", "region")
    lines = i.select("order_id", "product_id", "quantity", "line_total").join(od, "order_id").join(p.select("product_id", "category"), "product_id")
    out = lines.select(
        F.year("order_date").alias("year"), F.month("order_date").alias("month"),
        F.date_format("order_date", "yyyy-MM").alias("year_month"), "category", "region", "quantity", "line_total",
    ).groupBy("year", "month", "year_month", "category", "region").agg(
        F.sum("quantity").alias("total_quantity"),
        F.sum("line_total").cast("decimal(38,6)").alias("total_revenue"),
        F.count(F.lit(1)).alias("total_transactions"),
        div_round(F.sum("line_total"), F.count(F.lit(1)), 6, in_scale=6).alias("avg_transaction_value"))
    return out.orderBy("year", "month", "category", "region")


def geographic_sales(T: dict) -> DataFrame:
    """M7: per (country, state, city, region) by revenue, descending.

    Orders are summed per customer first; the customer join is then 1:1 and
    the distinct-customer count is a plain row count.
    """
    c, o = T["customers"], T["orders"]
    per_c = o.groupBy("customer_id").agg(
        F.count("order_id").alias("n"), F.sum("total_amount").alias("rev"),
        F.count("total_amount").alias("n_amt"))
    out = c.select("customer_id", "country", "state", "city", "region").join(per_c, "customer_id").groupBy(
        "country", "state", "city", "region").agg(
        F.count(F.lit(1)).alias("unique_customers"),
        F.sum("n").alias("total_orders"),
        money(F.sum("rev")).alias("total_revenue"),
        div_round(F.sum("rev"), F.sum("n_amt"), 6).alias("avg_order_value"))
    return out.orderBy(F.desc("total_revenue"), "country", "state", "city", "region")


# ------------------------------------------------------------------ M8 / M9

def summary_report(customers_m: DataFrame, products_m: DataFrame, monthly_m: DataFrame) -> DataFrame:
    """M8: one row of global figures over the M4 / M5 / M6 marts.

    One aggregate pass per mart: customers are first reduced per segment
    (which also yields the top segment, ties to the lowest name), products
    and sales ride along as struct-valued scalar subqueries, so no join of
    any kind is planned and no mart is scanned twice.
    """
    seg = customers_m.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("total_orders") > 0, 1)).alias("active"),
        F.sum("total_revenue").alias("rev"), F.count("total_revenue").alias("n_rev"))
    prod = products_m.agg(F.struct(
        F.count(F.lit(1)).alias("total_products"),
        F.count(F.when(F.col("total_quantity_sold") > 0, 1)).alias("products_sold"),
        F.min_by("product_name", F.struct(F.col("total_revenue").isNull(), -F.col("total_revenue"), F.col("product_id"))).alias("top"),
        avg_exact("total_revenue", 6).alias("avg_rev"))).scalar()
    sales = monthly_m.agg(F.struct(
        F.sum("total_revenue").cast("decimal(38,6)").alias("total_revenue"),
        F.sum("total_transactions").alias("total_transactions"),
        avg_exact("total_revenue", 6).alias("avg_rev"))).scalar()
    zero6 = F.lit(0).cast("decimal(18,6)")
    return seg.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_customers"),
        F.coalesce(F.sum("active"), F.lit(0).cast("bigint")).alias("active_customers"),
        F.coalesce(div_round(F.sum("rev"), F.sum("n_rev"), 6), zero6).alias("avg_customer_value"),
        F.min_by("customer_segment", F.struct(-F.col("n"), F.col("customer_segment"))).alias("top_customer_segment"),
    ).select(
        "total_customers", "active_customers", "avg_customer_value", "top_customer_segment",
        prod["total_products"].alias("total_products"),
        prod["products_sold"].alias("products_sold"),
        prod["top"].alias("top_selling_product"),
        F.coalesce(prod["avg_rev"], zero6).alias("avg_product_revenue"),
        F.coalesce(sales["total_revenue"], F.lit(0).cast("decimal(38,6)")).alias("total_revenue"),
        F.coalesce(sales["total_transactions"], F.lit(0).cast("bigint")).alias("total_transactions"),
        F.coalesce(sales["avg_rev"], zero6).alias("avg_monthly_revenue"),
    )


def profile_count(tables: dict[str, DataFrame]) -> DataFrame:
    """M9: row count of each input table, one row per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ M10-M13

def cross_sell(T: dict, min_count: int = 1) -> DataFrame:
    """Product pairs bought in the same order.

    pair_count = orders holding both; support = pair_count / orders;
    confidence = pair_count / orders holding a; lift = support / (s_a * s_b).
    The basket is built once per use; its shuffle on the order serves the
    pairs, which meet the counts in as many tasks as they are built by, and the global order count is a scalar subquery, not a join.
    """
    b = basket(T["order_items"])
    tasks = pair_tasks(b)
    n_orders = b.select(F.countDistinct("order_id")).scalar()
    cnt = b.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs_of(b, tasks=tasks)
    if min_count > 1:
        pairs = pairs.where(F.col("pair_count") >= min_count)
    ca = cnt.select(F.col("product_id").alias("product_a"), F.col("n").alias("orders_a"))
    cb = cnt.select(F.col("product_id").alias("product_b"), F.col("n").alias("orders_b"))
    # A product has one row per product that it meets: no task gets many more.
    near = lambda df, key: dealt(df, tasks, key)
    out = near(near(pairs, "product_a").join(near(ca, "product_a"), "product_a"), "product_b").join(near(cb, "product_b"), "product_b")
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  a product of two counts is beyond BIGINT
    lift = (wide(F.col("pair_count")) * wide(n_orders)) / F.nullif(wide(F.col("orders_a")) * wide(F.col("orders_b")), F.lit(0))
    return out.select(
        "product_a", "product_b", "pair_count", "orders_a", "orders_b",
        div_round("pair_count", n_orders, 6).alias("support"),
        div_round("pair_count", "orders_a", 6).alias("confidence"),
        F.round(lift, 6).cast("decimal(18,6)").alias("lift"))


def cohort_retention(T: dict) -> DataFrame:
    """First-order month x months since: active customers and rate.

    Orders collapse to distinct (customer, month) first; the cohort size is
    taken from the month-0 cell of the already aggregated cohort table.
    """
    o = T["orders"]
    cm = o.select("customer_id", (F.year("order_date") * 12 + F.month("order_date") - 1).alias("m")).distinct()
    first = cm.groupBy("customer_id").agg(F.min("m").alias("c"))
    cells = cm.join(first, "customer_id").groupBy("c", (F.col("m") - F.col("c")).alias("months_since")).agg(
        F.count(F.lit(1)).alias("active_customers"))
    size = cells.where(F.col("months_since") == 0).select("c", F.col("active_customers").alias("cohort_size"))
    out = cells.join(size, "c")
    return out.select(
        F.format_string("%04d-%02d", (F.col("c") / 12).cast("int"), (F.col("c") % 12 + 1).cast("int")).alias("cohort_month"),
        F.col("months_since").cast("int").alias("months_since"),
        "cohort_size", "active_customers",
        div_round("active_customers", "cohort_size", 4).alias("retention_rate"))


def inventory_status(T: dict) -> DataFrame:
    """Stock against the minimum level per product."""
    p = T["products"]
    low = F.col("stock_quantity") < F.col("min_stock_level")
    return p.select(
        "product_id", "product_name", "stock_quantity", "min_stock_level",
        F.when(low, F.lit("low")).otherwise(F.lit("ok")).alias("stock_status"),
        F.greatest(F.col("min_stock_level") - F.col("stock_quantity"), F.lit(0)).cast("int").alias("units_to_reorder"))


def segment_value(m1: DataFrame) -> DataFrame:
    """Customer value by segment, over the customer mart."""
    return m1.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.count(F.when(F.col("total_orders") > 0, 1)).alias("active_customers"),
        money(F.sum("total_spent")).alias("total_spent"),
        avg_exact("total_spent").alias("avg_spent"),
        avg_exact("total_orders").alias("avg_orders"))
