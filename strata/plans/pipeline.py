"""Layered pipeline runner (S10): raw -> clean -> marts, published together.

The raw tables are checked first (they have rows and the columns that the
clean layer needs).  The clean layer is written once, the marts are built from
what was written, and the summary of job b from the written marts.  Job b
drops copies of orders and lines in parts by order and writes them in these
parts (buckets): its marts join them without shuffling the lines.  All of it
goes into the run's own folder; only when every table has passed its checks do
they become visible, together (see ``strata.sources.publish``).  A failure
leaves what an earlier run published.  Errors are returned in the result, and
``raise_errors`` (default) re-raises, so a failing run cannot be reported as
success.
"""

from __future__ import annotations

import time
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from strata.operators import clean as C
from strata.operators import marts as M
from strata.operators.joins import tasks_for
from strata.plans.registry import register
from strata.session import checkpoint_dir
from strata.sources.adapters import Tables
from strata.sources.publish import Run, ValidationError, input_state, published, read_published


@dataclass
class PipelineResult:
    success: bool
    metrics: dict = field(default_factory=dict)
    errors: list = field(default_factory=list)
    version: int | None = None


# The marts of each job, their output partition columns and keys.
MARTS_A = {
    "customer_analytics": (lambda T: M.customer_analytics(T), None, ["customer_id"]),
    "product_analytics": (lambda T: M.product_analytics(T), None, ["product_id"]),
    "monthly_sales": (lambda T: M.monthly_sales(T), ["order_year", "order_month"], None),
}
MARTS_B = {
    "customer_analytics": (lambda T: M.customer_profile(T), ["customer_segment"], ["customer_id"]),
    "product_analytics": (lambda T: M.product_profile(T), ["category"], ["product_id"]),
    "monthly_sales": (lambda T: M.monthly_category_sales(T), ["year", "month"], None),
    "geographic_analytics": (lambda T: M.geographic_sales(T), ["country"], None),
}
# What the raw tables must have.
REQUIRED = {
    "customers": ["customer_id", "email", "customer_segment"], "orders": ["order_id", "customer_id", "order_date", "order_status", "total_amount"],
    "order_items": ["order_id", "product_id", "quantity"], "products": ["product_id", "price", "cost"],
}
INPUTS = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]


def check_raw(raw) -> None:
    """Raise unless every raw table has its columns and a row."""
    for name, columns in REQUIRED.items():
        df = getattr(raw, name)
        lost = [c for c in columns if c not in df.columns]
        if lost:
            raise ValidationError(f"{name}: no column {', '.join(lost)}")
        if not df.limit(1).count():
            raise ValidationError(f"{name}: no raw rows")


def run_pipeline(spark: SparkSession, sf_dir: str, out_dir: str, job: str = "a",
                 raise_errors: bool = True, tables=None, state: str = "", marts: dict | None = None) -> PipelineResult:
    """Run a job; ``tables`` gives the four raw tables where they are not the
    stand-ins of ``sf_dir``, ``state`` what the input's state is noted as."""
    t0, raw, T, run = time.time(), tables or Tables(spark, sf_dir), {}, Run(spark, out_dir)
    marts = marts or (MARTS_A if job == "a" else MARTS_B)
    res = PipelineResult(success=False, metrics={"marts": len(marts)})
    step = "raw input"
    try:
        check_raw(raw)
        # Buckets in proportion to the lines, counted before.
        buckets = (tasks_for(spark, raw.order_items.count()) or spark.sparkContext.defaultParallelism) if job != "a" else None
        for name, df in C.clean_all(raw, job, buckets).items():
            step = name
            T[name] = run.write(f"clean/{name}", df, buckets=(buckets, "order_id") if buckets and "order" in name else None)
        res.metrics["tables_processed"] = len(T)
        written: dict[str, DataFrame] = {}
        for name, (build, parts, key) in marts.items():
            step = name
            written[name] = run.write(name, build(T), parts, key)
            res.metrics[f"{name}_row_count"] = run.rows[name][2]
        if job != "a":
            step = "summary_report"
            run.write(step, M.summary_report(written["customer_analytics"], written["product_analytics"], written["monthly_sales"]))
        step = "publish"
        res.version = run.publish(state)
        res.success = True
    except Exception as e:  # noqa: BLE001 - reported in the result
        res.errors.append(f"{step}: {e}")
        if raise_errors:
            raise
    finally:
        run.close()
    res.metrics["processing_time_seconds"] = round(time.time() - t0, 3)
    return res


def current_marts(spark: SparkSession, sf_dir: str, job: str = "a", out_dir: str | None = None) -> dict[str, DataFrame]:
    """The published marts of a job over ``sf_dir``, built anew only where the
    input's files have changed since (or none are published)."""
    out = out_dir or f"{checkpoint_dir(spark).rstrip('/')}/marts-{job}-{zlib.crc32(sf_dir.encode()):08x}"
    state = input_state(spark, [f"{sf_dir}/{t}.parquet" for t in INPUTS])
    rows = published(spark, out)
    if not rows or {r["input_state"] for r in rows.values()} != {state}:
        run_pipeline(spark, sf_dir, out, job, state=state)
        rows = published(spark, out)
    return {name: read_published(spark, out, name) for name in rows if not name.startswith("clean/")}


register("ecommerce_analytics_a", lambda spark, sf, out: run_pipeline(spark, sf, out, "a"))
register("ecommerce_analytics_b", lambda spark, sf, out: run_pipeline(spark, sf, out, "b"))
