"""Registered queries for sources, sinks, the pipeline and the streams.

These write intermediate results into fresh folders under the session's
shared checkpoint directory (never a machine-local temp folder) and return
what a reader sees afterwards.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import clean as C
from strata.operators import governance as G
from strata.operators import marts as M
from strata.operators import profiles as PR
from strata.operators import quality as Q
from strata.operators.audit import WATCHED_NAMES
from strata.plans.pipeline import run_pipeline
from strata.sources.publish import read_published
from strata.session import materialized
from strata.sources import adapters as AD
from strata.sources import catalog as CAT
from strata.sources import io as IO
from strata.sources.crawler import crawl, crawl_update
from strata.sources.logs import log_records
from strata.sources.adapters import Tables
from strata.streaming import jobs as S
from strata.streaming.alarms import alarm_stream


def _monthly_written(spark: SparkSession, sf: str) -> str:
    path = S.scratch(spark, "monthly_sales")
    IO.write_table(M.monthly_sales(C.clean_all(Tables(spark, sf), "a")), path,
                   partition_by=["order_year", "order_month"])
    return path


def write_mart(spark: SparkSession, sf: str):
    """Write the monthly mart partitioned, read it back."""
    return IO.read_table(spark, _monthly_written(spark, sf), "parquet")


def partition_repair(spark: SparkSession, sf: str):
    """S5 + S6: external partitioned table over the written mart, partitions
    discovered and listed."""
    path = _monthly_written(spark, sf)
    name = "monthly_sales_" + path.rsplit("-", 1)[-1]
    res = CAT.create_tables(spark, {name: {"location": path, "format": "parquet",
                                           "partition_by": ["order_year", "order_month"]}})
    if not res.first()["success"]:
        raise RuntimeError(res.first()["error"])
    parts = CAT.repair_partitions(spark, f"strata.{name}")  # listed by now, one row per partition
    CAT.drop_table(spark, f"strata.{name}")
    return parts


def create_tables_q(spark: SparkSession, sf: str):
    """One table from data, one from a declared CSV schema, one that fails."""
    path, csv = _monthly_written(spark, sf), S.scratch(spark, "orders-csv")
    Tables(spark, sf).orders.select("order_id", "currency").write.option("header", "true").option("sep", "|").csv(csv)
    tag = "_" + path.rsplit("-", 1)[-1]
    out = CAT.create_tables(spark, {
        "monthly_sales" + tag: {"location": path, "format": "parquet", "partition_by": ["order_year", "order_month"]},
        "orders" + tag: {"location": csv, "format": "csv", "options": {"sep": "|", "header": "true"},
                         "schema": [{"name": "order_id", "type": "bigint"}, {"name": "currency", "type": "string"}]},
        "nowhere" + tag: {"location": path + "-missing", "format": "parquet", "partition_by": ["x"]}})
    rows = [(r["table_name"].removesuffix(tag), r["success"], r["error"] is not None) for r in out.collect()]  # one row per table
    CAT.drop_table(spark, "strata.monthly_sales" + tag)
    CAT.drop_table(spark, "strata.orders" + tag)
    return spark.createDataFrame(rows, "table_name string, success boolean, has_error boolean")


def crawl_schema(spark: SparkSession, sf: str):
    """The tables of a lake folder, with their partition columns."""
    base = S.scratch(spark, "lake")
    IO.write_table(M.monthly_sales(C.clean_all(Tables(spark, sf), "a")), f"{base}/monthly_sales", partition_by=["order_year", "order_month"])
    AD.events(spark, sf).select("event_id", "event_type", "ts").write.parquet(f"{base}/events")
    return crawl(spark, base)


def crawl_update_q(spark: SparkSession, sf: str):
    """A lake of three formats, crawled into the catalog, grown by a column
    and crawled again: what changed, and the rows that the tables give."""
    base, nation = S.scratch(spark, "lake"), AD._read(spark, sf, "nation")
    parts = AD._read(spark, sf, "region").select("r_regionkey", "r_name")
    AD.events(spark, sf).select("event_id", "ts", "event_type").write.partitionBy("event_type").parquet(f"{base}/events")
    parts.write.json(f"{base}/regions")
    nation.select("n_nationkey", "n_name").write.option("header", "true").csv(f"{base}/nations")
    tag = base.rsplit("-", 1)[-1] + "_"
    crawl_update(spark, base, prefix=tag)
    nation.select("n_nationkey", "n_name", "n_regionkey").write.mode("overwrite").option("header", "true").csv(f"{base}/nations")
    AD.events(spark, sf).select("event_id", "ts", F.lit("copy").alias("event_type"), "user_id").write.mode("append").partitionBy("event_type").parquet(f"{base}/events")
    report = crawl_update(spark, base, prefix=tag)
    rows = None
    for t, added in (("events", "user_id"), ("nations", "n_regionkey"), ("regions", "r_name")):
        r = spark.table(f"strata.{tag}{t}").agg(F.count(F.lit(1)).alias("row_count"), F.count(added).alias("values_added")).withColumn("table_name", F.lit(t))
        rows = rows.unionByName(r) if rows else r
    out = report.select("table_name", "column_name", "is_partition", "change", "format", "applied").join(rows, "table_name")
    out = materialized(out, "crawl-report")
    for t in ("events", "nations", "regions"):
        CAT.drop_table(spark, f"strata.{tag}{t}")
    return out


def read_csv(spark: SparkSession, sf: str):
    """Customers written as CSV with a header, read with inferred types."""
    path = S.scratch(spark, "customers-csv")
    Tables(spark, sf).customers.write.option("header", "true").csv(path)
    return IO.read_table(spark, path, "csv")


ITEM_DECLARED = [
    {"name": "order_item_id", "type": "string"}, {"name": "order_id", "type": "bigint"},
    {"name": "product_id", "type": "bigint"}, {"name": "supplier_id", "type": "bigint"},
    {"name": "quantity", "type": "bigint"}, {"name": "total_price", "type": "decimal(12,2)"},
    {"name": "discount", "type": "decimal(5,4)"}, {"name": "discount_applied", "type": "decimal(18,6)"},
    {"name": "tax", "type": "decimal(5,4)"}, {"name": "return_flag", "type": "string"},
    {"name": "item_status", "type": "string"}, {"name": "ship_date", "type": "date"},
]


def _items_csv(spark: SparkSession, sf: str):
    """Items as headed CSV, every 50th with a quantity that is no number, read
    back against a declared schema: (good rows, rejected rows)."""
    path = S.scratch(spark, "items-csv")
    items = Tables(spark, sf).order_items.select(*[c["name"] for c in ITEM_DECLARED])
    items = items.withColumn("quantity", F.when(F.col("order_id") % 50 == 0, "many").otherwise(F.col("quantity").cast("string")))
    # Every seventh order's items have a line feed in their status.
    items = items.withColumn("item_status", F.when(F.col("order_id") % 7 == 0, F.concat("item_status", F.lit("\nchecked"))).otherwise(F.col("item_status")))
    items.write.option("header", "true").csv(path)
    return IO.read_declared(spark, path, IO.schema_from_json(ITEM_DECLARED))


def read_declared(spark: SparkSession, sf: str):
    """S3: the rows that fit the declared schema."""
    return _items_csv(spark, sf)[0]


def read_declared_rejects(spark: SparkSession, sf: str):
    """S3: the rows that do not, with the reason and the raw line."""
    return _items_csv(spark, sf)[1].select(
        "order_item_id", F.lit("does not fit the declared schema").alias("reason"), F.col("_corrupt_record").alias("line"))


def read_json_logs(spark: SparkSession, sf: str):
    """Events as JSON lines, read back."""
    path = S.scratch(spark, "events-json")
    exact = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    AD.events(spark, sf).write.options(**exact).json(path)
    return IO.read_table(spark, path, "json", **exact, schema="event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")


def read_log_records(spark: SparkSession, sf: str):
    """Events as a job logs them, errors with a stack trace below, read back
    as records."""
    path = S.scratch(spark, "events-log")
    trace = F.concat(F.lit("\nTraceback (most recent call last):\n\n  File \"job.py\", line "), F.col("user_id").cast("string"), F.lit("\nValueError: "), F.coalesce("props", F.lit("-")))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - user-"), F.col("user_id").cast("string"),
                    F.when(F.col("event_type") == "error", " - ERROR - ").otherwise(" - INFO - "), F.lit("event "), F.col("event_id").cast("string"),
                    F.when(F.col("event_type") == "error", trace).otherwise(""))
    AD.events(spark, sf).select(line.alias("value")).write.text(path)
    return log_records(spark, path).select("log_time", "logger", "level", "message", "part", "n_lines", F.md5("text").alias("text_md5"))


def role_views(spark: SparkSession, sf: str):
    """Customers in three layers, and what each role's views show of them."""
    t, base = Tables(spark, sf), S.scratch(spark, "governed")
    clean = C.clean_all(t, "a")["customers"]
    tag = base.rsplit("-", 1)[-1]
    shown = ["customer_id", "email", "phone", "sensitive_ssn", "region"]
    layers = {"customers_raw": ("raw", t.customers), "customers": ("clean", clean), "contacts": ("analytics", clean.select(*shown))}
    for name, (_, df) in layers.items():
        IO.write_table(df, f"{base}/{name}")
    CAT.create_tables(spark, {name: {"location": f"{base}/{name}"} for name in layers}, f"governed_{tag}")
    views = G.role_views(spark, {f"governed_{tag}.{name}": layer for name, (layer, _) in layers.items()}, f"governed_{tag}")
    out = None
    for role, name in [(r["role"], r["table_name"]) for r in views.where("reason IS NULL").collect()]:  # roles times tables
        v = spark.sql(f"SELECT * FROM governed_{tag}_{role}.{name}")
        v = v.select(F.lit(role).alias("role"), F.lit(name).alias("table_name"), *[c if c in v.columns else F.lit(None).cast("string").alias(c) for c in shown])
        out = out.unionByName(v) if out else v
    out = materialized(out, "role-views")
    for db in [f"governed_{tag}_{role}" for role in G.DEFAULT_POLICY] + [f"governed_{tag}"]:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
    return out


def dq_profile_merged(spark: SparkSession, sf: str):
    """G1: orders profiled month by month and merged; whether the distinct values
    are within four standard errors of the exact profile's."""
    orders = C.clean_all(Tables(spark, sf), "a")["orders"]
    path = S.scratch(spark, "profiles")
    # The last day of each month is late: its months are profiled again.
    PR.store_profiles(PR.partition_profiles(orders.where("order_date < last_day(order_date)"), "order_period"), path)
    late = orders.where("order_date = last_day(order_date)").select("order_period").distinct()
    PR.store_profiles(PR.partition_profiles(orders.join(late, "order_period", "left_semi"), "order_period"), path)
    merged = PR.merged_profile(spark.read.parquet(path))
    exact = Q.profile(orders.drop("order_period")).select("column_name", "distinct_count")
    error = 4 * 1.04 / 2 ** (PR.LG_K / 2)
    return merged.join(exact, "column_name").select(
        "column_name", "total_rows", "null_count", "min_value", "max_value",
        (F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= F.lit(error) * F.col("distinct_count") + F.lit(1)).alias("distinct_within_error"))


def pipeline_q(spark: SparkSession, sf: str, job: str = "a"):
    """Run a job end to end; one row per metric."""
    res = run_pipeline(spark, sf, S.scratch(spark, "pipeline"), job)
    rows = [(k, str(v)) for k, v in sorted(res.metrics.items()) if k != "processing_time_seconds"]
    rows.append(("success", str(res.success)))
    return spark.createDataFrame(rows, "metric string, value string")


def pipeline_summary(spark: SparkSession, sf: str):
    """S10, job b: the summary that was built from the written marts."""
    out = S.scratch(spark, "pipeline-b")
    run_pipeline(spark, sf, out, "b")
    return read_published(spark, out, "summary_report")


def _stream_schema(spark: SparkSession, sf: str, name: str) -> T.StructType:
    return AD._read(spark, sf, name).schema


def stream_ingest(spark: SparkSession, sf: str):
    """Order files streamed and cleaned: the valid rows."""
    return _ingested(spark, sf)[0]


def stream_rejects(spark: SparkSession, sf: str):
    """What the rules reject, with the violations."""
    return _ingested(spark, sf)[1].select("order_id", "customer_id", F.array_join("violations", ",").alias("violations"))


def _ingested(spark: SparkSession, sf: str):
    src = S.file_stream(spark, S.table_path(sf, "orders"), _stream_schema(spark, sf, "orders"))
    root = S.scratch(spark, "ingest")
    # Every 40th order arrives without its customer.
    lost = lambda df: df.withColumn("customer_id", F.when(F.col("order_id") % 40 != 0, F.col("customer_id")))
    # Text in one case, columns in their declared types.
    raw = AD.orders_from(AD._read(spark, sf, "orders")).schema
    transform = lambda df: C.canonical_status(C.cast_to(C.standardize(lost(AD.orders_from(df)), {"currency": "upper"}), raw), "order_status")
    schema = transform(AD._read(spark, sf, "orders")).schema
    S.stream_ingest(src, f"{root}/clean", f"{root}/checkpoint", [*C.default_rules("orders"), C.date_rule()], transform, f"{root}/rejected", key=["order_id"]).awaitTermination()
    return S.read_sink(spark, f"{root}/clean", schema), S.read_sink(spark, f"{root}/rejected", S.with_reasons(schema))


def stream_metrics(spark: SparkSession, sf: str):
    """R2: 1-minute windows per metric with a 2-minute watermark."""
    sch = _stream_schema(spark, sf, "events")
    return S.run_to_table(spark, lambda: S.metric_windows(AD.metrics_from(
        S.file_stream(spark, S.table_path(sf, "events"), sch))), "metrics")


def stream_alarm(spark: SparkSession, sf: str):
    """W2 as a stream: alarms of the periods that the watermark has closed."""
    sch = _stream_schema(spark, sf, "events")
    return S.run_to_table(spark, lambda: alarm_stream(AD.service_metrics_from(
        S.file_stream(spark, S.table_path(sf, "events"), sch)), "250", 4), "alarms")


def stream_security(spark: SparkSession, sf: str):
    """Watched-name counts per hour."""
    sch = _stream_schema(spark, sf, "events")
    return S.run_to_table(spark, lambda: S.security_windows(AD.audit_from(
        S.file_stream(spark, S.table_path(sf, "events"), sch)), WATCHED_NAMES), "security")


def stream_event_log(spark: SparkSession, sf: str):
    """Event rows appended partitioned by service and hour."""
    sch = _stream_schema(spark, sf, "events")
    out = S.run_to_table(spark, lambda: S.event_log_rows(
        S.file_stream(spark, S.table_path(sf, "events"), sch)), "eventlog", ["service", "hour"])
    return out.withColumn("hour", F.col("hour").cast("string"))


IO_QUERIES = {
    "read_any": lambda s, d: IO.read_table(s, f"{d}/orders.parquet", "parquet"),
    "read_csv": read_csv,
    "read_declared": read_declared,
    "read_declared_rejects": read_declared_rejects,
    "write_mart": write_mart,
    "partition_repair": partition_repair,
    "create_tables": create_tables_q,
    "crawl_schema": crawl_schema,
    "crawl_update": crawl_update_q,
    "validate_input": lambda s, d: IO.validate_input(s, f"{d}/orders.parquet").select("has_rows"),
    "run_pipeline": pipeline_q,
    "run_pipeline_b": lambda s, d: pipeline_q(s, d, "b"),
    "pipeline_summary": pipeline_summary,
    "read_json_logs": read_json_logs,
    "read_log_records": read_log_records,
    "role_views": role_views,
    "dq_profile_merged": dq_profile_merged,
    "stream_ingest": stream_ingest,
    "stream_rejects": stream_rejects,
    "stream_metrics": stream_metrics,
    "stream_alarm": stream_alarm,
    "stream_security": stream_security,
    "stream_event_log": stream_event_log,
}
