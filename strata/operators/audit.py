"""Audit-event reports (O9, O10) and the watch-list join."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.dates import ts_lit

# The watched event names of the security report.
WATCHED_NAMES = ("error", "signup", "purchase", "create_user", "delete_bucket")


def _window(events: DataFrame, as_of: datetime, hours: int) -> DataFrame:
    lo = as_of - timedelta(hours=hours)
    return events.where((F.col("eventTime") >= ts_lit(lo)) & (F.col("eventTime") < ts_lit(as_of)))


def audit_recent(events: DataFrame, as_of: datetime, hours: int = 1) -> DataFrame:
    """Events of the last ``hours`` hours, newest first."""
    return (_window(events, as_of, hours)
            .select("eventTime", "eventName", "sourceIPAddress",
                    F.col("userIdentity.type").alias("identity_type"), "event_id")
            .orderBy(F.desc("eventTime"), "event_id"))


def watchlist_join(names: DataFrame, counts: DataFrame, key: str = "eventName") -> DataFrame:
    """Every watched name with its count, 0 when it never occurred.

    ``counts`` was already filtered to the watch list, so it holds at most one
    row per watched name: its size is bounded by the list and it is safe to
    broadcast.
    """
    return (names.join(F.broadcast(counts), key, "left")
            .select(key, F.coalesce(F.col("event_count"), F.lit(0).cast("bigint")).alias("event_count")))


def security_counts(spark: SparkSession, events: DataFrame, as_of: datetime,
                    names=WATCHED_NAMES, hours: int = 24) -> DataFrame:
    """Counts of the watched names over the last ``hours`` hours."""
    names = list(dict.fromkeys(names))
    counts = (_window(events, as_of, hours).where(F.col("eventName").isin(names))
              .groupBy("eventName").agg(F.count(F.lit(1)).alias("event_count")))
    name_df = spark.createDataFrame([(n,) for n in names], "eventName string")
    return watchlist_join(name_df, counts)
