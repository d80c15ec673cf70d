"""Oracle SQL per registered key (DuckDB dialect, tables pre-registered)."""

from __future__ import annotations

from oracle import marts_sql as MS
from oracle import reports_sql as RS
from oracle import ops_sql as OS
from oracle import clean_sql as CS
from oracle.sqlkit import with_base


def _m(ctes: str, body: str) -> str:
    return with_base(body, ctes)


def m1_sql(grain="order"):
    return _m(MS.M1_ORDER if grain == "order" else MS.M1_ITEM, MS.M1_SELECT)


def m1_cte(grain="order") -> str:
    """M1 as CTE text ending in ``m1 AS (...)`` for queries built on it."""
    return (MS.M1_ORDER if grain == "order" else MS.M1_ITEM) + f",\nm1 AS ({MS.M1_SELECT})"


def m2_cte(grain="order") -> str:
    return (MS.M2_ORDER if grain == "order" else MS.M2_ITEM) + f",\nm2x AS ({MS.M2_SELECT})"


def m3_cte(grain="order") -> str:
    return (MS.M3_ORDER if grain == "order" else MS.M3_ITEM) + f",\nm3x AS ({MS.M3_SELECT})"


_cs_ctes, _cs_body = MS.cross_sell_sql(1)

MART_SQL = {
    "customer_analytics": m1_sql("order"),
    "customer_analytics_item": m1_sql("item"),
    "product_analytics": _m(MS.M2_ORDER, MS.M2_SELECT),
    "product_analytics_item": _m(MS.M2_ITEM, MS.M2_SELECT),
    "monthly_sales": _m(MS.M3_ORDER, MS.M3_SELECT),
    "monthly_sales_item": _m(MS.M3_ITEM, MS.M3_SELECT),
    "customer_analytics_b": _m(MS.M4, MS.M4_SELECT),
    "customer_analytics_b_item": _m(MS.M4.replace("count(DISTINCT i.product_id)", "count(i.product_id)"),
                                    MS.M4_SELECT),
    "product_analytics_b": _m(MS.M5, "SELECT * FROM m5"),
    "monthly_sales_b": _m(MS.M6, "SELECT * FROM m6"),
    "geographic_analytics": _m(MS.M7, "SELECT * FROM m7"),
    "summary_report": _m(MS.M4 + "," + MS.M5 + "," + MS.M6 + "," + MS.M8, MS.M8_SELECT),
    "basic_count": with_base(MS.M9_SELECT),
    "cross_sell": _m(_cs_ctes, _cs_body),
    "cohort_retention": _m(MS.COHORT, MS.COHORT_SELECT),
    "inventory_status": with_base(MS.INVENTORY),
    "segment_value": _m(m1_cte("order"), MS.SEGMENT_SELECT),
}


_M1, _M2, _M3 = m1_cte(), m2_cte(), m3_cte()

REPORT_SQL = {
    "top_customers": _m(_M1, RS.TOP_CUSTOMERS),
    "segment_country": _m(_M1, RS.SEGMENT_COUNTRY),
    "retention_type": _m(_M1, RS.RETENTION_TYPE),
    "top_products": _m(_M2, RS.TOP_PRODUCTS),
    "category_performance": _m(_M2, RS.CATEGORY),
    "brand_performance": _m(_M2, RS.BRAND),
    "top_profitable": _m(_M2, RS.TOP_PROFITABLE),
    "monthly_trend": _m(_M3, RS.MONTHLY_TREND),
    "yoy_growth": _m(_M3 + "," + RS.YOY_CTE, RS.YOY),
    "currency_performance": _m(_M3, RS.CURRENCY),
    "lifetime_value": _m(_M1 + "," + RS.LTV_CTE, RS.LTV),
    "completeness_check": _m(_M1 + "," + _M2, RS.COMPLETENESS),
    "freshness_check": _m(_M1 + "," + _M3, RS.FRESHNESS),
    "freshness_check_literal": _m(_M1 + "," + _M3, RS.FRESHNESS_LITERAL),
    "sample_rows": _m(_M2, RS.SAMPLE_ROWS),
    "top_one": _m(MS.M5, "SELECT product_id, product_name, total_revenue FROM m5 "
                         "ORDER BY total_revenue DESC, product_id LIMIT 1"),
}


def _o(body: str, ctes: str = "") -> str:
    return with_base(body, OS.OPS_BASE + ("," + ctes if ctes else ""))


OPS_SQL = {
    "cost_by_service": _o(OS.COST_BY_SERVICE),
    "cost_daily_trend": _o(OS.COST_DAILY_TREND),
    "cost_summary": _o(OS.COST_SUMMARY),
    "top_services": _o(OS.TOP_SERVICES),
    "cost_month_to_date": _o(OS.COST_MTD),
    "daily_cost_alert": _o(OS.DAILY_ALERT_SELECT, OS.DAILY_ALERT),
    "budget_running": _o(OS.BUDGET_RUNNING_SELECT, OS.BUDGET_RUNNING),
    "budget_status": _o(OS.BUDGET_STATUS_SELECT, OS.BUDGET_STATUS),
    "cost_anomaly": _o(OS.ANOMALY_SELECT, OS.ANOMALY),
    "cluster_run_cost": _o(OS.CLUSTER_COST_SELECT, OS.CLUSTER_COST),
    "audit_recent": _o(OS.AUDIT_RECENT),
    "security_counts": _o(OS.security_counts(24)),
    "watchlist_join": _o(OS.security_counts(24 * 31)),
    "span_metrics": _o(OS.SPAN_METRICS),
    "trace_summary": _o(OS.TRACE_SUMMARY),
    "span_parenting": _o(OS.SPAN_PARENTING, OS.SPAN_ISLANDS),
    "stack_health": _o(OS.STACK_HEALTH),
    "metric_alarm": _o(OS.METRIC_ALARM),
    "alarm_consecutive": _o(OS.ALARM_CONSECUTIVE_SELECT, OS.ALARM_CONSECUTIVE),
    "storage_by_class": _o(OS.STORAGE_BY_CLASS),
    "version_counts": _o(OS.VERSION_COUNTS),
    "lifecycle_tier": _o(OS.LIFECYCLE_TIER, OS.LIFECYCLE),
    "lifecycle_summary": _o(OS.LIFECYCLE_SUMMARY, OS.LIFECYCLE),
    "log_retention": _o(OS.LOG_RETENTION),
    "log_sort": _o("SELECT eventTime, eventName, sourceIPAddress, event_id FROM audit_events "
                   "ORDER BY eventTime DESC, event_id LIMIT 100"),
    "task_report": _o(OS.TASK_REPORT),
    "module_health": _o(OS.MODULE_HEALTH),
}


CLEAN_SQL = {
    "standardize_text": with_base(CS.STANDARDIZE),
    "cast_schema": with_base(CS.CAST_SCHEMA),
    "filter_valid": with_base(CS.FILTER_VALID),
    "dedupe_rows": with_base(CS.DEDUPE),
    "date_parts": with_base(CS.DATE_PARTS),
    "normalize_dates": with_base(CS.NORMALIZE_DATES),
    "line_total": with_base(CS.LINE_TOTAL),
    "fill_defaults": with_base(CS.FILL_DEFAULTS),
    "canonical_status": with_base(CS.CANONICAL_STATUS),
    "quarantine": with_base(CS.QUARANTINE),
    "quarantine_orders": with_base(CS.QUARANTINE_ORDERS),
    "email_rule": with_base(CS.EMAIL_RULE),
    "missing_values": with_base(CS.MISSING),
    "dq_profile": with_base(CS.DQ_PROFILE),
    "dq_referential": with_base(CS.DQ_REFERENTIAL),
    "mask_columns": with_base(CS.MASK_COLUMNS),
    "row_filter": with_base(CS.ROW_FILTER),
    "table_access": _m(_M1, CS.TABLE_ACCESS),
    "join_orders_items": with_base(CS.JOIN_ORDERS_ITEMS),
    "join_using": with_base(CS.JOIN_USING),
    "star_join": with_base(CS.STAR_JOIN),
    "dim_left_fact": with_base(CS.DIM_LEFT_FACT),
    "customers_orders": with_base(CS.CUSTOMERS_ORDERS),
    "basket_pairs": _m(_cs_ctes, CS.BASKET_PAIRS),
    "read_any": CS.READ_ANY,
    "write_mart": _m(_M3, CS.WRITE_MART),
    "partition_repair": _m(_M3, CS.PARTITION_REPAIR),
    "read_declared": with_base(CS.READ_DECLARED),
    "read_declared_rejects": with_base(CS.READ_DECLARED_REJECTS),
    "read_csv": with_base(CS.READ_CSV),
    "read_json_logs": CS.READ_JSON,
    "read_log_records": CS.READ_LOGS,
    "role_views": with_base(CS.ROLE_VIEWS),
    "dq_profile_merged": with_base(CS.DQ_PROFILE_MERGED),
    "create_tables": CS.CREATE_TABLES,
    "crawl_schema": CS.CRAWL,
    "crawl_update": CS.CRAWL_UPDATE,
    "visible_tables": with_base("SELECT bucket || '/' || key AS table_name, layer FROM objects WHERE layer IN ('clean', 'analytics')", OS.OPS_BASE),
    "quarantine_rows": with_base(CS.QUARANTINE_ROWS),
    "fill_missing": with_base(CS.FILL_MISSING),
    "run_pipeline_b": _m(f"{MS.M4},\nm4 AS ({MS.M4_SELECT}),{MS.M5},{MS.M6},{MS.M7}", CS.RUN_PIPELINE_B),
    "pipeline_summary": _m(MS.M4 + "," + MS.M5 + "," + MS.M6 + "," + MS.M8, MS.M8_SELECT),
    "trace_spans": with_base(OS.TRACE_SPANS, OS.OPS_BASE),
    "log_objects": with_base(OS.LOG_OBJECTS, OS.OPS_BASE),
    "task_details": with_base(OS.TASK_DETAILS, OS.OPS_BASE),
    "sample_customers": _m(_M1, "SELECT * FROM m1 ORDER BY total_spent DESC, customer_id LIMIT 5"),
    "sample_monthly": _m(_M3, "SELECT * FROM m3x ORDER BY order_year DESC, order_month DESC, currency LIMIT 5"),
    "run_pipeline": _m(f"{_M1},\n{_M2},\n{_M3}", CS.RUN_PIPELINE),
    "stream_metrics": with_base(CS.STREAM_METRICS, OS.OPS_BASE),
    "stream_alarm": _o(OS.STREAM_ALARM, OS.ALARM_CONSECUTIVE),
    "stream_security": with_base(CS.STREAM_SECURITY.format(names="'error', 'signup', 'purchase', 'create_user', 'delete_bucket'"), OS.OPS_BASE),
    "stream_rejects": with_base(CS.STREAM_REJECTS),
    "validate_input": CS.VALIDATE_INPUT,
    "stream_ingest": with_base(CS.STREAM_INGEST),
    "stream_event_log": CS.STREAM_EVENT_LOG,
}


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(CLEAN_SQL)
    out.update(MART_SQL)
    out.update(REPORT_SQL)
    out.update(OPS_SQL)
    return out
