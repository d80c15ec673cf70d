"""Every registered query: key -> callable(spark, sf_dir) -> DataFrame.

Keys follow the operator inventory; each callable reads the scale-factor
folder's parquet tables (through the adapters) and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import clean as C
from strata.operators import marts as M
from strata.operators import reports as R
from strata.operators import audit as A
from strata.operators import governance as G
from strata.operators import joins as J
from strata.operators import quality as Q
from strata.functions.dates import parse_dates
from pyspark.sql import types as T
from strata.plans.pipeline import current_marts
from strata.operators import costs as CO
from strata.operators import storage as ST
from strata.operators import tasks as TK
from strata.operators import telemetry as TL
from strata.sources import adapters as AD
from strata.sources.adapters import AS_OF, Tables

Query = Callable[[SparkSession, str], DataFrame]


def tables_a(spark: SparkSession, sf_dir: str) -> dict:
    return C.clean_all(Tables(spark, sf_dir), "a")


def tables_b(spark: SparkSession, sf_dir: str) -> dict:
    return C.clean_all(Tables(spark, sf_dir), "b")


def m1(spark, sf, grain="order"):
    return M.customer_analytics(tables_a(spark, sf), grain)


def m2(spark, sf, grain="order"):
    return M.product_analytics(tables_a(spark, sf), grain)


def m3(spark, sf, grain="order"):
    return M.monthly_sales(tables_a(spark, sf), grain)


def _summary(spark, sf):
    """M8 from the published marts of job b."""
    P = current_marts(spark, sf, "b")
    return M.summary_report(P["customer_analytics"], P["product_analytics"], P["monthly_sales"])


def _completeness(spark, sf):
    """U1 over the published marts of job a."""
    P = current_marts(spark, sf, "a")
    return R.completeness_check(P["customer_analytics"], P["product_analytics"])


MART_QUERIES: dict[str, Query] = {
    "customer_analytics": lambda s, d: m1(s, d, "order"),
    "customer_analytics_item": lambda s, d: m1(s, d, "item"),
    "product_analytics": lambda s, d: m2(s, d, "order"),
    "product_analytics_item": lambda s, d: m2(s, d, "item"),
    "monthly_sales": lambda s, d: m3(s, d, "order"),
    "monthly_sales_item": lambda s, d: m3(s, d, "item"),
    "customer_analytics_b": lambda s, d: M.customer_profile(tables_b(s, d)),
    "customer_analytics_b_item": lambda s, d: M.customer_profile(tables_b(s, d), grain="item"),
    "product_analytics_b": lambda s, d: M.product_profile(tables_b(s, d)),
    "monthly_sales_b": lambda s, d: M.monthly_category_sales(tables_b(s, d)),
    "geographic_analytics": lambda s, d: M.geographic_sales(tables_b(s, d)),
    "summary_report": _summary,
    "basic_count": lambda s, d: M.profile_count(tables_a(s, d)),
    "cross_sell": lambda s, d: M.cross_sell(tables_a(s, d)),
    "cohort_retention": lambda s, d: M.cohort_retention(tables_a(s, d)),
    "inventory_status": lambda s, d: M.inventory_status(tables_a(s, d)),
    "segment_value": lambda s, d: M.segment_value(m1(s, d)),
}


REPORT_QUERIES: dict[str, Query] = {
    "top_customers": lambda s, d: R.top_customers(m1(s, d)),
    "segment_country": lambda s, d: R.segment_country(m1(s, d)),
    "retention_type": lambda s, d: R.retention_type(m1(s, d)),
    "top_products": lambda s, d: R.top_products(m2(s, d)),
    "category_performance": lambda s, d: R.category_performance(m2(s, d)),
    "brand_performance": lambda s, d: R.brand_performance(m2(s, d)),
    "top_profitable": lambda s, d: R.top_profitable(m2(s, d)),
    "monthly_trend": lambda s, d: R.monthly_trend(m3(s, d)),
    "yoy_growth": lambda s, d: R.yoy_growth(m3(s, d)),
    "currency_performance": lambda s, d: R.currency_performance(m3(s, d)),
    "lifetime_value": lambda s, d: R.lifetime_value(m1(s, d)),
    "completeness_check": _completeness,
    "freshness_check": lambda s, d: R.freshness_check(m1(s, d), m3(s, d)),
    "freshness_check_literal": lambda s, d: R.freshness_check(m1(s, d), m3(s, d), literal=True),
    "sample_rows": lambda s, d: R.sample_rows(m2(s, d), [F.desc("total_revenue"), F.asc("product_id")], 5),
    "sample_customers": lambda s, d: R.sample_rows(m1(s, d), [F.desc("total_spent"), F.asc("customer_id")], 5),
    "sample_monthly": lambda s, d: R.sample_rows(m3(s, d), [F.desc("order_year"), F.desc("order_month"), F.asc("currency")], 5),
    "top_one": lambda s, d: R.top_one(M.product_profile(tables_b(s, d)), "total_revenue", "product_id",
                                      ["product_id", "product_name", "total_revenue"]),
}


def _aged(spark, sf):
    """Objects with the time they were modified, and their age at ``AS_OF``."""
    o = AD.storage_objects(spark, sf)
    return ST.with_age(o.withColumn("modified", F.date_sub(F.lit(AS_OF).cast("date"), F.col("age_days")).cast("timestamp_ntz")), AS_OF)


_SERVICES = ["click", "error", "purchase", "signup", "view"]

OPS_QUERIES: dict[str, Query] = {
    "cost_by_service": lambda s, d: CO.cost_by_service(AD.cost_lines(s, d), "2024-01-01", AS_OF),
    "cost_daily_trend": lambda s, d: CO.cost_daily_trend(AD.cost_lines(s, d), AS_OF, 7),
    "cost_summary": lambda s, d: CO.cost_summary(AD.cost_lines(s, d), AS_OF, 7),
    "top_services": lambda s, d: CO.top_services(AD.cost_lines(s, d), AS_OF, 7, 10, "0.01"),
    "cost_month_to_date": lambda s, d: CO.cost_month_to_date(AD.cost_lines(s, d), AS_OF, "p0"),
    "daily_cost_alert": lambda s, d: CO.daily_cost_alert(AD.cost_lines(s, d), "10"),
    "budget_running": lambda s, d: CO.budget_running(AD.cost_lines(s, d), "100"),
    "budget_status": lambda s, d: CO.budget_status(AD.cost_lines(s, d), AS_OF, "100", _SERVICES),
    "cost_anomaly": lambda s, d: CO.cost_anomaly(AD.cost_lines(s, d), 7, 3),
    "cluster_run_cost": lambda s, d: CO.cluster_run_cost(AD.cluster_runs(s, d), AS_OF, "1.5", name_prefix="cluster-"),
    "audit_recent": lambda s, d: A.audit_recent(AD.audit_events(s, d), AS_OF, 1),
    "security_counts": lambda s, d: A.security_counts(s, AD.audit_events(s, d), AS_OF, hours=24),
    "watchlist_join": lambda s, d: A.security_counts(s, AD.audit_events(s, d), AS_OF, hours=24 * 31),
    "span_metrics": lambda s, d: TL.span_metrics(AD.spans(s, d)),
    "trace_summary": lambda s, d: TL.trace_summary(AD.spans(s, d)),
    "span_parenting": lambda s, d: TL.span_parenting(AD.spans(s, d)),
    "trace_spans": lambda s, d: TL.trace_spans(AD.spans(s, d)),
    "stack_health": lambda s, d: TL.stack_health(TL.stacks_from_events(AD.events(s, d))),
    "metric_alarm": lambda s, d: TL.metric_alarm(AD.service_metrics(s, d), "450", "1 day"),
    "alarm_consecutive": lambda s, d: TL.alarm_consecutive(AD.service_metrics(s, d), "250", 4),
    "storage_by_class": lambda s, d: ST.storage_by_class(AD.storage_objects(s, d)),
    "version_counts": lambda s, d: ST.version_counts(AD.storage_objects(s, d)),
    "lifecycle_tier": lambda s, d: ST.lifecycle_tier(_aged(s, d)),
    "lifecycle_summary": lambda s, d: ST.lifecycle_summary(_aged(s, d)),
    "log_retention": lambda s, d: ST.log_retention(AD.storage_objects(s, d)),
    "log_sort": lambda s, d: R.newest(AD.audit_events(s, d).select(
        "eventTime", "eventName", "sourceIPAddress", "event_id"), "eventTime", 100, "event_id"),
    "log_objects": lambda s, d: ST.log_objects(AD.storage_objects(s, d).select(
        "bucket", F.concat(F.lit("log-"), F.col("key"), F.element_at(F.array(*map(F.lit, (".log", ".gz", ".txt"))), (F.col("key") % 3 + 1).cast("int"))).alias("name"),
        F.date_sub(F.lit(AS_OF).cast("date"), F.col("age_days")).alias("modified")), AS_OF),
    "task_details": lambda s, d: TK.task_details(AD.task_runs(s, d)),
    "task_report": lambda s, d: TK.task_report(AD.task_runs(s, d)),
    "module_health": lambda s, d: TK.module_health(AD.task_runs(s, d)),
}


def _dates_text(spark, sf):
    o = Tables(spark, sf).orders
    k = F.col("order_id") % 3
    text = (F.when(k == 0, F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))
            .when(k == 1, F.date_format("order_date", "MM/dd/yyyy HH:mm"))
            .otherwise(F.date_format("order_date", "MMM d yyyy HH:mm")))
    return parse_dates(o.select("order_id", text.alias("order_date_text")), "order_date_text",
                       out="order_ts")


_ITEM_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.IntegerType()), T.StructField("total_price", T.DecimalType(10, 2)),
    T.StructField("discount", T.DecimalType(5, 4))])


def _fill_defaults(spark, sf):
    t = tables_a(spark, sf)
    per_c = t["orders"].where(F.col("order_status") == "completed").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("completed_orders"), F.sum("total_amount").alias("completed_amount"))
    out = J.dim_left_fact(t["customers"].select("customer_id", "customer_segment"), per_c, "customer_id",
                          ["completed_orders", "completed_amount"])
    return out


def _items_per_product(spark, sf):
    t = tables_a(spark, sf)
    agg = t["order_items"].groupBy("product_id").agg(F.count(F.lit(1)).alias("lines"),
                                                     F.sum("quantity").alias("units"))
    return J.dim_left_fact(t["products"].select("product_id", "product_name"), agg, "product_id",
                           ["lines", "units"])


CLEAN_QUERIES: dict[str, Query] = {
    "standardize_text": lambda s, d: C.standardize(
        Tables(s, d).customers, {"email": "lower", "customer_segment": "upper", "city": "trim"}
    ).select("customer_id", "email", "customer_segment", "city"),
    "cast_schema": lambda s, d: C.cast_to(Tables(s, d).order_items, _ITEM_SCHEMA),
    "filter_valid": lambda s, d: tables_b(s, d)["orders"].select(
        "order_id", "customer_id", "order_status", "total_amount"),
    "dedupe_rows": lambda s, d: C.dedupe(Tables(s, d).order_items),
    "date_parts": lambda s, d: tables_a(s, d)["orders"].select(
        "order_id", "order_date", "order_year", "order_month", "order_day", "order_period"),
    "normalize_dates": _dates_text,
    "line_total": lambda s, d: tables_b(s, d)["order_items"].select(
        "order_id", "product_id", "quantity", "unit_price", "discount", "line_total"),
    "fill_defaults": _fill_defaults,
    "canonical_status": lambda s, d: tables_a(s, d)["orders"].groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders")),
    "quarantine": lambda s, d: C.quarantine_summary(Tables(s, d).customers, C.default_rules("customers")),
    "quarantine_orders": lambda s, d: C.quarantine_summary(Tables(s, d).orders, [*C.default_rules("orders"), C.date_rule()]),
    "email_rule": lambda s, d: Tables(s, d).customers.select(
        "customer_id", "email", C.email_rule("email")[1].alias("email_ok")),
    "quarantine_rows": lambda s, d: C.split_by_rules(Tables(s, d).customers.withColumn(
        "email", F.when(F.col("customer_id") % 9 != 0, F.col("email")).otherwise("no mail")), C.default_rules("customers"))[1].select(
        "customer_id", "email", F.array_join("violations", ",").alias("violations")),
    "fill_missing": lambda s, d: C.fill_missing(Tables(s, d).customers, {"phone": "unknown"}).select("customer_id", "phone"),
    "missing_values": lambda s, d: C.missing_report(Tables(s, d).customers),
    "dq_profile": lambda s, d: Q.profile(tables_a(s, d)["orders"]),
    "dq_referential": lambda s, d: Q.orphans(tables_a(s, d)),
    "mask_columns": lambda s, d: G.apply_policy(tables_a(s, d)["customers"], "analyst"),
    "row_filter": lambda s, d: G.apply_policy(tables_a(s, d)["customers"], "analyst_europe"),
    "visible_tables": lambda s, d: G.visible_tables(G.policy_table(s), AD.storage_objects(s, d).select(
        F.concat_ws("/", "bucket", F.col("key").cast("string")).alias("table_name"), "layer"), "analyst").select("table_name", "layer"),
    "table_access": lambda s, d: G.read_as("viewer", "analytics", m1(s, d)),
    "join_orders_items": lambda s, d: J.join_orders_items(
        tables_a(s, d)["orders"].select("order_id", "customer_id", "order_status"),
        tables_a(s, d)["order_items"].select("order_id", "product_id", "quantity")),
    "join_using": lambda s, d: J.join_using(
        tables_a(s, d)["orders"].select("order_id", "order_date"),
        tables_a(s, d)["order_items"].select("order_id", "product_id", "total_price"), "order_id"),
    "star_join": lambda s, d: J.star_join(
        tables_a(s, d)["orders"].select("order_id", "currency"),
        tables_a(s, d)["order_items"].select("order_id", "product_id", "quantity"),
        tables_a(s, d)["products"]),
    "dim_left_fact": _items_per_product,
    "customers_orders": lambda s, d: J.customers_orders(
        tables_b(s, d)["customers"].select("customer_id", "country"),
        tables_b(s, d)["orders"].select("order_id", "customer_id", "total_amount")),
    "basket_pairs": lambda s, d: J.basket_pairs(tables_a(s, d)["order_items"]),
}


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    from strata.plans.registered_io import IO_QUERIES
    out.update(CLEAN_QUERIES)
    out.update(IO_QUERIES)
    out.update(MART_QUERIES)
    out.update(REPORT_QUERIES)
    out.update(OPS_QUERIES)
    return out
