"""Stand-in tables built from the driver's star-schema parquet files.

The commerce model (customers, orders, order_items, products) and the
operational tables (cost lines, audit events, spans, metrics, storage
objects, cluster runs, task runs) are projections and small lookups over
``customer nation region part orders lineitem events documents``.  All of it
is lazy column arithmetic; Catalyst prunes whatever a query does not use, so
``ReadSchema`` on each scan only carries the referenced raw columns.

No division or rounding happens here, so values are exact in any engine.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The evaluation instant of every "last N days / hours" window.
AS_OF = datetime(2024, 1, 31, 0, 0, 0)

# Order status letter -> status text, line status -> item status,
# custkey % 3 -> currency, event type -> task status.
ORDER_STATUS = {"F": "completed", "O": "processing", "P": "cancelled"}
ITEM_STATUS = {"O": "processing", "F": "delivered"}
CURRENCIES = {0: "JPY", 1: "USD", 2: "CNY"}
TASK_STATUS = {"error": "failed", "purchase": "completed", "signup": "completed",
               "click": "running", "view": "pending"}
# Storage layer by doc_id % 4.
LAYERS = {0: "raw", 1: "clean", 2: "analytics", 3: "query-results"}


def _case(col: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == F.lit(k), F.lit(v)) if out is None else out.when(col == F.lit(k), F.lit(v))
    return out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# commerce model
# --------------------------------------------------------------------------

def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    n = _read(spark, sf_dir, "nation")
    r = _read(spark, sf_dir, "region")
    # nation / region are the fixed 25 / 5 row TPC-H dimensions; the planner
    # broadcasts them from their parquet statistics.
    geo = n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")
    k = F.col("c_custkey")
    return c.join(geo, c.c_nationkey == geo.n_nationkey, "left").select(
        k.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.lit("Customer").alias("first_name"),
        F.expr("substring(c_name, 10)").alias("last_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(k % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("555-"), k.cast("string"))).alias("phone"),
        F.concat(F.lit("Street "), k.cast("string")).alias("address"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.lpad((k % 100000).cast("string"), 5, "0").alias("zip_code"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 365).cast("int")).alias("registration_date"),
        F.when(k % 7 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int"))).alias("last_login"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.concat(F.lit("000-00-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("sensitive_ssn"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_from(_read(spark, sf_dir, "orders"))


def orders_from(o: DataFrame) -> DataFrame:
    """Order rows from a TPC-H style ``orders`` frame (batch or stream)."""
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        _case(F.col("o_orderstatus"), ORDER_STATUS).alias("order_status"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
        (F.col("o_custkey") % 50).cast("decimal(12,2)").alias("discount_amount"),
        (F.col("o_orderkey") % 100).cast("decimal(12,2)").alias("tax_amount"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 5).cast("decimal(12,2)").alias("shipping_cost"),
        _case(F.col("o_custkey") % 3, CURRENCIES).alias("currency"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    total = F.col("l_extendedprice").cast("decimal(12,2)")
    disc = F.col("l_discount").cast("decimal(5,4)")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        total.alias("total_price"),
        disc.alias("discount"),
        (total * disc).cast("decimal(18,6)").alias("discount_applied"),
        F.col("l_tax").cast("decimal(5,4)").alias("tax"),
        F.col("l_returnflag").alias("return_flag"),
        _case(F.col("l_linestatus"), ITEM_STATUS).alias("item_status"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(10,2)")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.substring("p_name", 1, 3).alias("subcategory"),
        F.col("p_brand").alias("brand"),
        price.alias("price"),
        (price - F.col("p_size")).cast("decimal(10,2)").alias("cost"),
        F.concat(F.lit("SUP-"), (F.col("p_partkey") % 10).cast("string")).alias("supplier"),
        F.lit(None).cast("date").alias("launch_date"),
        F.col("p_size").alias("stock_quantity"),
        F.lit(20).alias("min_stock_level"),
    )


def with_unit_price(items: DataFrame, products: DataFrame) -> DataFrame:
    """Attach ``unit_price`` (the product's list price) to item rows.

    Left join on the product key: the product side is a dimension; AQE turns
    it into a broadcast when its runtime size is under the threshold and a
    sort-merge join (with skew splitting) otherwise.
    """
    p = products.select("product_id", F.col("price").alias("unit_price"))
    return items.join(p, "product_id", "left")


class Tables:
    """The four raw commerce tables of one scale-factor folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._memo: dict[str, DataFrame] = {}

    def _get(self, name, fn):
        if name not in self._memo:
            self._memo[name] = fn(self.spark, self.sf_dir)
        return self._memo[name]

    @property
    def customers(self) -> DataFrame:
        return self._get("customers", raw_customers)

    @property
    def orders(self) -> DataFrame:
        return self._get("orders", raw_orders)

    @property
    def order_items(self) -> DataFrame:
        return self._get("order_items", raw_order_items)

    @property
    def products(self) -> DataFrame:
        return self._get("products", raw_products)

    @property
    def priced_items(self) -> DataFrame:
        return with_unit_price(self.order_items, self.products)

    def raw(self, name: str) -> DataFrame:
        return _read(self.spark, self.sf_dir, name)


# --------------------------------------------------------------------------
# operational tables, all derived from `events` / `documents`
# --------------------------------------------------------------------------

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events")


def cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("service"),
        # Wider than cents: sums are compared before they are rounded.
        F.col("value").cast("decimal(18,6)").alias("amount"),
        F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")).alias("project"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_from(events(spark, sf_dir))


def audit_from(e: DataFrame) -> DataFrame:
    """Audit events from an ``events`` frame (batch or stream)."""
    return e.select(
        F.col("ts").alias("eventTime"),
        F.col("event_type").alias("eventName"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("sourceIPAddress"),
        F.struct(F.lit("User").alias("type")).alias("userIdentity"),
        F.col("event_id"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per event; a trace is one user's day; its root is the first
    event by (ts, event_id) and every other span has the root as parent.

    The root is found with a grouped ``min(struct)`` (partial aggregation, so
    a hot trace is combined map-side) and joined back on the trace key.
    """
    e = events(spark, sf_dir)
    base = e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"),
        F.col("event_id").alias("span_id"),
        F.col("event_type").alias("operation_name"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service_name"),
        F.col("ts").alias("start_time"),
        F.col("value").cast("decimal(12,2)").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.col("props").alias("tags"),
    )
    roots = base.groupBy("trace_id").agg(
        F.min(F.struct("start_time", "span_id"))["span_id"].alias("root_span_id"))
    return (base.join(roots, "trace_id", "left")
            .withColumn("parent_span_id",
                        F.when(F.col("span_id") == F.col("root_span_id"), F.lit(None).cast("bigint"))
                         .otherwise(F.col("root_span_id")))
            .drop("root_span_id"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_from(events(spark, sf_dir))


def service_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples with the service as their dimension."""
    return service_metrics_from(events(spark, sf_dir))


def service_metrics_from(e: DataFrame) -> DataFrame:
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))
    return metrics_from(e.withColumn("service", service), "service")


def metrics_from(e: DataFrame, dimension: str = "user") -> DataFrame:
    """Metric samples from an ``events`` frame (batch or stream)."""
    return e.select(
        F.lit("strata").alias("namespace"),
        F.col("event_type").alias("name"),
        F.col("value").cast("decimal(12,2)").alias("value"),
        F.lit("Count").alias("unit"),
        F.create_map(F.lit(dimension), F.col("user_id" if dimension == "user" else dimension).cast("string")).alias("dimensions"),
        F.col("ts").alias("timestamp"),
    )


def storage_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        F.col("source").alias("bucket"),
        k.alias("key"),
        F.col("n_chars").alias("size"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("storage_class"),
        (k % 400).cast("int").alias("age_days"),
        _case(k % 4, LAYERS).alias("layer"),
        (k % 11 == 0).alias("is_delete_marker"),
    )


def cluster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("cluster-"), F.col("user_id").cast("string")).alias("name"),
        F.lit("WAITING").alias("state"),
        F.col("ts").alias("creation_time"),
    )


def task_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("task"),
        F.col("user_id").alias("module"),
        _case(F.col("event_type"), TASK_STATUS).alias("status"),
        F.col("ts").alias("ts"),
        F.col("value").cast("decimal(12,2)").alias("result"),
    )
