"""Task-run report (O20) and module health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_report(tasks: DataFrame) -> DataFrame:
    """Total, completed, failed, running, pending and the integer
    success rate (completed * 100 div total)."""
    s = F.col("status")
    agg = tasks.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count(F.when(s == "completed", 1)).alias("completed"),
        F.count(F.when(s == "failed", 1)).alias("failed"),
        F.count(F.when(s == "running", 1)).alias("running"),
        F.count(F.when(s == "pending", 1)).alias("pending"),
        F.count(F.when(s == "skipped", 1)).alias("skipped"))
    rate = F.when(F.col("total_tasks") > 0,
                  F.expr("completed * 100 div total_tasks")).otherwise(F.lit(0).cast("bigint"))
    return agg.withColumn("success_rate", rate)


def task_details(tasks: DataFrame) -> DataFrame:
    """O20 detail lines: one JSON text per task."""
    return tasks.select("task", F.to_json(F.struct("task", "module", "status", "result")).alias("detail"))


def module_health(tasks: DataFrame, healthy=("completed",)) -> DataFrame:
    """Latest status per module (by time, then task id); healthy / total."""
    latest = tasks.groupBy("module").agg(F.max_by("status", F.struct("ts", "task")).alias("status"))
    agg = latest.agg(
        F.count(F.lit(1)).alias("total_modules"),
        F.count(F.when(F.col("status").isin(list(healthy)), 1)).alias("healthy_modules"))
    return agg.withColumn("health_pct", F.when(
        F.col("total_modules") > 0, F.expr("healthy_modules * 100 div total_modules")))
