"""Spans and metrics.

Spans: (trace_id, span_id, parent_span_id, operation_name, service_name,
start_time, duration_ms DECIMAL, status).  Metrics: (namespace, name, value,
unit, dimensions MAP, timestamp).

Per-trace figures are grouped aggregates (partial aggregation combines a
hot trace map-side); nothing collects a trace's spans into one list.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import materialized


def span_metrics(spans: DataFrame, namespace: str = "strata") -> DataFrame:
    """One OperationDuration row per span and one OperationErrors row
    per failed span, with the metric's namespace, its Status dimension and the
    time in epoch milliseconds; the error kind comes from the span's tags
    (``Unknown`` where they have none)."""
    kind = F.get_json_object("tags", "$.k") if "tags" in spans.columns else F.lit(None).cast("string")
    dur = F.struct(F.lit("OperationDuration").alias("metric_name"),
                   F.col("duration_ms").cast("decimal(12,2)").alias("value"),
                   F.lit("Milliseconds").alias("unit"), F.lit(None).cast("string").alias("error_kind"))
    err = F.when(F.col("status") == "error",
                 F.struct(F.lit("OperationErrors").alias("metric_name"),
                          F.lit(Decimal("1.00")).cast("decimal(12,2)").alias("value"),
                          F.lit("Count").alias("unit"), F.coalesce(kind, F.lit("Unknown")).alias("error_kind")))
    return (spans.select(F.lit(namespace).alias("namespace"), "span_id", "trace_id", "operation_name", "service_name", "status",
                         F.unix_millis(F.col("start_time").cast("timestamp")).alias("epoch_ms"),
                         F.explode(F.array_compact(F.array(dur, err))).alias("m"))
            .select("namespace", "span_id", "trace_id", "operation_name", "service_name", "status", "epoch_ms", "m.*"))


def trace_summary(spans: DataFrame) -> DataFrame:
    """Per trace: spans, errors, status, first operation and its service, time range and
    the longest root-span duration (NULL when the trace has no root)."""
    is_root = F.col("parent_span_id").isNull()
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.count(F.when(F.col("status") == "error", 1)).alias("error_count"),
        F.max(F.when(is_root, F.col("duration_ms"))).cast("decimal(12,2)").alias("total_duration_ms"),
        F.min("start_time").alias("trace_start"),
        F.max("start_time").alias("trace_end"),
        F.min_by("operation_name", F.struct("start_time", "span_id")).alias("first_operation"),
        F.min_by("service_name", F.struct("start_time", "span_id")).alias("service_name"),
    ).withColumn("status", F.when(F.col("error_count") > 0, F.lit("error")).otherwise(F.lit("ok")))


def trace_spans(spans: DataFrame) -> DataFrame:
    """The spans of each trace in start order, as long rows.

    The rows are dealt by ranges of (trace, start, id) and written, so that
    every reader sees the same ranges.  A span's position is its place in its
    trace's part of a range, plus the trace's spans in the ranges before: a
    trace of any size is numbered by as many tasks as it has ranges.
    """
    order = ["start_time", "span_id"]
    dealt = spans.select("trace_id", *order, "service_name", "operation_name").repartitionByRange("trace_id", *order)
    dealt = materialized(dealt.withColumn("_range", F.spark_partition_id()), "ranked-spans")
    sizes = dealt.groupBy("trace_id", "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("trace_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("trace_id", "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("trace_id", "_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(offsets, ["trace_id", "_range"]).select(
        "trace_id", (F.col("_before") + F.col("_place")).cast("long").alias("position"), "span_id", "service_name", "operation_name")


#: Microseconds of a parent's time that one task sweeps.
SWEEP_US = 1_000_000


def covered_time(parts: DataFrame, keys: list[str], sweep_us: int = SWEEP_US) -> DataFrame:
    """(keys, covered_us): the length of the union of the intervals [s, e) of
    each key, in microseconds.

    Intervals are swept by their starts: one adds what lies beyond the
    furthest end so far.  A key's time is cut into ranges of ``sweep_us``; what
    ends furthest before a range comes in at its border, so the ranges of a hot
    key are swept side by side.  Intervals that start together are one, so a
    range holds no more rows than it has microseconds.
    """
    heads = parts.where("s < e").groupBy(*keys, "s").agg(F.max("e").alias("e")).withColumn("_range", F.floor(F.col("s") / sweep_us))
    tops = heads.groupBy(*keys, "_range").agg(F.max("e").alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    border = tops.select(*keys, "_range", F.max("top").over(earlier).alias("border"))
    inside = Window.partitionBy(*keys, "_range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    swept = heads.withColumn("reached", F.max("e").over(inside)).join(border, [*keys, "_range"])
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reached", "border"))
    return swept.groupBy(*keys).agg(F.sum(fresh).alias("covered_us"))


def span_parenting(spans: DataFrame, sweep_us: int = SWEEP_US) -> DataFrame:
    """Children per span, self time and orphan spans whose parent id is
    not a known span.

    Self time is the time of a span in which none of its children runs: its
    duration without the union of its children's times, each clipped to the
    span.  So it is never negative and never more than the duration, also
    where children run side by side, outlast the span or start before it; a
    span without a start or a duration has nothing clipped.

    Spans are known by trace and span id; where rows repeat an id, each is
    measured by its own times.  Roots have no parent and stay out of the last
    join, so that they do not meet in one task.
    """
    start, length = F.unix_micros(F.col("start_time").cast("timestamp")), (F.col("duration_ms") * 1000).cast("bigint")
    timed = spans.withColumn("_s", start).withColumn("_e", start + length)
    # A child without times covers nothing; greatest and least would pass over its nulls.
    kids = timed.where(F.col("parent_span_id").isNotNull()).select("trace_id", F.col("parent_span_id").alias("span_id"), F.col("_s").alias("ks"), F.col("_e").alias("ke"))
    n = kids.groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("n_children"))
    key = ["trace_id", "span_id", "_s", "_e"]
    parents = timed.select(*key).where("_s < _e").distinct()
    parts = kids.where("ks < ke").join(parents, ["trace_id", "span_id"]).select(*key, F.greatest("ks", "_s").alias("s"), F.least("ke", "_e").alias("e"))
    out = timed.join(n, ["trace_id", "span_id"], "left").join(covered_time(parts, key, sweep_us), key, "left")
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct().withColumn("_found", F.lit(True))
    child = out.where(F.col("parent_span_id").isNotNull()).join(known, ["trace_id", "parent_span_id"], "left")
    roots = out.where(F.col("parent_span_id").isNull()).withColumn("_found", F.lit(True))
    covered_ms = (F.coalesce("covered_us", F.lit(0)).cast("decimal(20,0)") / 1000).cast("decimal(18,3)")
    return child.unionByName(roots).select(
        "span_id", "trace_id", "parent_span_id",
        F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
        (F.col("duration_ms") - covered_ms).cast("decimal(18,3)").alias("self_time_ms"),
        F.col("_found").isNull().alias("is_orphan"))


# Stack status rules, tried in order (first match wins).
STACK_RULES = (
    ("exact", ("CREATE_COMPLETE", "UPDATE_COMPLETE"), "1"),
    ("contains", ("IN_PROGRESS",), "0.5"),
    ("contains", ("FAILED", "ROLLBACK"), "0"),
    ("exact", ("DOES_NOT_EXIST",), "-1"),
)


def status_score(col: str = "status", rules=STACK_RULES, default: str = "0") -> F.Column:
    """Ordered wildcard rules -> score (DECIMAL(3,1))."""
    c = F.col(col)
    out = None
    for kind, words, score in rules:
        cond = c.isin(list(words)) if kind == "exact" else \
            _any([c.contains(w) for w in words])
        v = F.lit(Decimal(score)).cast("decimal(3,1)")
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(F.lit(Decimal(default)).cast("decimal(3,1)"))


def _any(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def stack_health(stacks: DataFrame) -> DataFrame:
    """Latest status per stack and its health score."""
    latest = stacks.groupBy("stack_name").agg(
        F.max_by("status", F.struct("ts", "check_id")).alias("status"),
        F.max("ts").alias("checked_at"))
    return latest.withColumn("health", status_score("status"))


#: What a metric is known by.
METRIC = ["namespace", "name", "dimensions"]


def dimension_text(col: str = "dimensions") -> F.Column:
    """A metric's dimensions as sorted ``key=value`` text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def metric_alarm(metrics: DataFrame, threshold: str, period: str = "1 day") -> DataFrame:
    """Maximum per metric (namespace, name, dimensions) and period against
    a threshold."""
    thr = F.lit(Decimal(threshold)).cast("decimal(12,2)")
    g = metrics.withColumn("dimensions", dimension_text()).groupBy(F.window("timestamp", period).alias("w"), *METRIC).agg(
        F.max("value").alias("max_value"))
    return g.select(F.col("w.start").alias("period_start"), *METRIC, "max_value",
                    thr.alias("threshold"), (F.col("max_value") > thr).alias("alarm"))


#: Periods of a gap that one row is expanded to.
GAP_CHUNK = 1_000


def alarm_consecutive(metrics: DataFrame, threshold: str, periods: int = 4, period: str = "hour") -> DataFrame:
    """Maximum per metric (namespace, name, dimensions) and ``period``
    (minute, hour, day) on a gap-filled grid; the alarm is on when the last
    ``periods`` of them all breach (a missing one does not).

    The alarm is decided on the periods that have samples: the last of them
    must breach and be neighbours in time.  Gaps are filled afterwards, from
    one sample to the next, in chunks of ``GAP_CHUNK``: a stray sample long ago
    makes rows, not one long array.
    """
    thr = F.lit(Decimal(threshold)).cast("decimal(12,2)")
    us = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}[period]
    # Truncate on the wall clock: the result stays TIMESTAMP_NTZ whatever the session zone.
    at = F.date_trunc(period, "timestamp").cast("timestamp_ntz")
    by_period = metrics.withColumn("dimensions", dimension_text()).groupBy(*METRIC, at.alias(period)).agg(F.max("value").alias("max_value"))
    number = F.floor(F.unix_micros(F.col(period).cast("timestamp")) / us)
    t = by_period.withColumn("breaching", F.coalesce(F.col("max_value") > thr, F.lit(False))).withColumn("_k", number)
    order = Window.partitionBy(*METRIC).orderBy("_k")
    last = order.rowsBetween(-(periods - 1), 0)
    t = t.withColumn("in_alarm", (F.sum(F.col("breaching").cast("int")).over(last) == periods) & (F.min("_k").over(last) == F.col("_k") - (periods - 1)))
    t = t.withColumn("_gap", F.coalesce(F.lead("_k").over(order) - F.col("_k") - 1, F.lit(0)))
    step = F.expr(f"INTERVAL 1 {period}")
    gaps = t.where("_gap > 0").select(*METRIC, period, "_gap", F.explode(F.sequence(F.lit(1).cast("bigint"), "_gap", F.lit(GAP_CHUNK).cast("bigint"))).alias("_from"))
    gaps = gaps.select(*METRIC, period, F.explode(F.sequence("_from", F.least("_gap", F.col("_from") + GAP_CHUNK - 1))).alias("_n"))
    gaps = gaps.select(*METRIC, (F.col(period) + step * F.col("_n")).cast("timestamp_ntz").alias(period), F.lit(None).cast("decimal(12,2)").alias("max_value"),
                       F.lit(False).alias("breaching"), F.lit(False).alias("in_alarm"))
    return t.select(*METRIC, period, "max_value", "breaching", "in_alarm").unionByName(gaps)


def stacks_from_events(events: DataFrame) -> DataFrame:
    """Stack status checks derived from events (one check per event)."""
    # Event type -> stack status text.
    status = (F.when(F.col("event_type") == "view", "CREATE_COMPLETE")
              .when(F.col("event_type") == "purchase", "UPDATE_COMPLETE")
              .when(F.col("event_type") == "click", "UPDATE_IN_PROGRESS")
              .when(F.col("event_type") == "error", "UPDATE_ROLLBACK_FAILED")
              .otherwise("DOES_NOT_EXIST"))
    return events.select(
        F.concat(F.lit("stack-"), (F.col("user_id") % 10).cast("string")).alias("stack_name"),
        status.alias("status"), F.col("ts"), F.col("event_id").alias("check_id"))

