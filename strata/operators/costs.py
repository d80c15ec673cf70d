"""Spend analytics over cost lines.

Cost lines: (date DATE, service STRING, amount DECIMAL, project STRING).
Every relative window takes an explicit ``as_of`` instant; nothing reads
the clock.  Windows (W3, O7) run over per-day aggregates, so a partition
holds at most one row per day however many lines a service has.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.numeric import div_round, money
from strata.functions.dates import ts_lit


def _d(x) -> Column:
    if isinstance(x, datetime):
        x = x.date()
    return F.lit(x).cast("date") if not isinstance(x, Column) else x


def _day(as_of) -> date:
    return as_of.date() if isinstance(as_of, datetime) else as_of


def cost_by_service(costs: DataFrame, start, end) -> DataFrame:
    """O1: spend per service over [start, end), services with spend > 0."""
    return (costs.where((F.col("date") >= _d(start)) & (F.col("date") < _d(end)))
            .groupBy("service").agg(F.sum("amount").alias("exact")).where(F.col("exact") > 0)
            .orderBy(F.desc("exact"), "service").select("service", money("exact").alias("total_cost")))


def cost_daily_trend(costs: DataFrame, as_of, days: int = 7) -> DataFrame:
    """O2: spend per day over the ``days`` days before ``as_of``."""
    end = _day(as_of)
    start = end - timedelta(days=days)
    return (costs.where((F.col("date") >= _d(start)) & (F.col("date") < _d(end)))
            .groupBy("date").agg(money(F.sum("amount")).alias("daily_cost"))
            .orderBy("date"))


def cost_summary(costs: DataFrame, as_of, days: int = 7) -> DataFrame:
    """O3: period total, total / days as the daily average, services seen."""
    end = _day(as_of)
    start = end - timedelta(days=days)
    w = costs.where((F.col("date") >= _d(start)) & (F.col("date") < _d(end)))
    return w.agg(
        _d(start).alias("period_start"), _d(end).alias("period_end"),
        money(F.coalesce(F.sum("amount"), F.lit(0))).alias("total_cost"),
        div_round(F.coalesce(F.sum("amount"), F.lit(0)), F.lit(days), 2, in_scale=6).alias("daily_average"),
        F.countDistinct("service").alias("services"))


def top_services(costs: DataFrame, as_of, days: int = 7, k: int = 10,
                 min_cost: str = "0.01") -> DataFrame:
    """T5: the ``k`` costliest services of the period, then only > min_cost.

    The threshold filter runs after the top-k, as the original report did.
    """
    end = _day(as_of)
    start = end - timedelta(days=days)
    per = (costs.where((F.col("date") >= _d(start)) & (F.col("date") < _d(end)))
           .groupBy("service").agg(F.sum("amount").alias("exact")))
    top = per.orderBy(F.desc("exact"), "service").limit(k)
    return top.where(F.col("exact") > F.lit(Decimal(min_cost))).select("service", money("exact").alias("total_cost"))


def cost_month_to_date(costs: DataFrame, as_of, project: str | None = None) -> DataFrame:
    """Spend since the 1st of the month of ``as_of``, all and one project."""
    end = _day(as_of)
    start = end.replace(day=1)
    w = costs.where((F.col("date") >= _d(start)) & (F.col("date") < _d(end)))
    proj = F.sum(F.when(F.col("project") == F.lit(project), F.col("amount"))) if project else F.lit(None)
    return w.agg(
        _d(start).alias("month_start"),
        money(F.coalesce(F.sum("amount"), F.lit(0))).alias("blended_total"),
        F.lit(project).cast("string").alias("project"),
        money(F.coalesce(proj, F.lit(0))).alias("project_total"))


def daily_cost_alert(costs: DataFrame, threshold: str = "10", project: str | None = None) -> DataFrame:
    """Per day: total, threshold, overage, alert flag, and the services
    above 0.01 as ``service:cost`` text, costliest first; of one project only
    if it is named.  Limits are compared with exact sums; only what is shown
    is rounded.

    The breakdown list per day is bounded by the number of services.
    """
    thr = F.lit(Decimal(threshold)).cast("decimal(18,2)")
    if project is not None:
        costs = costs.where(F.col("project") == project)
    per_ds = costs.groupBy("date", "service").agg(F.sum("amount").alias("cost"))
    item = F.when(F.col("cost") > F.lit(Decimal("0.01")),
                  F.struct((-F.col("cost")).alias("k"), F.col("service").alias("s"), money("cost").alias("c")))
    per_d = per_ds.groupBy("date").agg(F.sum("cost").alias("exact"), F.sort_array(F.collect_list(item)).alias("items"))
    return per_d.select(
        "date", money("exact").alias("total_cost"), thr.alias("threshold"),
        money(F.greatest(F.col("exact") - thr, F.lit(0))).alias("overage"),
        (F.col("exact") > thr).alias("alert"),
        F.array_join(F.transform("items", lambda x: F.concat(x["s"], F.lit(":"), x["c"].cast("string"))),
                     ", ").alias("breakdown"))


def _month_bounds(as_of):
    end = _day(as_of)
    start = (end - timedelta(days=1)).replace(day=1)
    nxt = (start.replace(day=28) + timedelta(days=4)).replace(day=1)
    return start, end, (nxt - start).days, (end - start).days


def budget_running(costs: DataFrame, limit: str = "100", services: list | None = None) -> DataFrame:
    """Month-to-date spend per day and the days it first exceeds 80 % and
    100 % of the monthly limit (greater than, as the alert rule has it)."""
    c = costs.where(F.col("service").isin(services)) if services else costs
    daily = c.groupBy("date").agg(F.sum("amount").alias("spend"))
    w = (Window.partitionBy(F.trunc("date", "month")).orderBy("date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lim = F.lit(Decimal(limit))
    run = daily.withColumn("mtd", F.sum("spend").over(w))
    prev = F.col("mtd") - F.col("spend")
    return run.select(
        "date", money("spend").alias("daily_cost"), money("mtd").alias("month_to_date"),
        div_round("mtd", lim, 2, factor=100, in_scale=6).alias("pct_of_limit"),
        ((F.col("mtd") > lim * F.lit(Decimal("0.8"))) & (prev <= lim * F.lit(Decimal("0.8")))).alias("crosses_80"),
        ((F.col("mtd") > lim) & (prev <= lim)).alias("crosses_100"))


def budget_status(costs: DataFrame, as_of, limit: str = "100", services: list | None = None) -> DataFrame:
    """Month spend against a limit: 80 % / 100 % actual, 100 % forecast.

    Forecast is linear: spend / elapsed days * days in month.
    """
    start, end, dim, elapsed = _month_bounds(as_of)
    c = costs.where((F.col("date") >= _d(start)) & (F.col("date") < _d(end)))
    if services:
        c = c.where(F.col("service").isin(services))
    lim = F.lit(Decimal(limit)).cast("decimal(18,2)")
    a = c.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("actual"))
    fc = div_round("actual", F.lit(elapsed), 2, factor=dim, in_scale=6)
    return a.select(
        _d(start).alias("month_start"), lim.alias("budget_limit"), money("actual").alias("actual"),
        div_round("actual", lim, 2, factor=100, in_scale=6).alias("pct_used"), fc.alias("forecast"),
        (F.col("actual") > lim * F.lit(Decimal("0.8"))).alias("actual_80"),
        (F.col("actual") > lim).alias("actual_100"),
        (F.col("actual") * dim > lim * elapsed).alias("forecast_100"))


def cost_anomaly(costs: DataFrame, days: int = 7, sigmas: int = 3) -> DataFrame:
    """Daily spend per service against the mean and sample standard
    deviation of the days with spend among the ``days`` calendar days before
    it (the current day excluded; a day without spend is no observation)."""
    daily = costs.groupBy("service", "date").agg(F.sum("amount").alias("spend"))
    w = Window.partitionBy("service").orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    t = daily.select(
        "service", "date", "spend",
        F.sum("spend").over(w).alias("s"), F.count("spend").over(w).alias("n"),
        F.stddev_samp("spend").over(w).alias("sd"))
    mean = div_round("s", "n", 2, in_scale=6)
    sd = F.round(F.col("sd"), 4).cast("decimal(18,4)")
    return t.select(
        "service", "date", money("spend").alias("daily_cost"), mean.alias("trailing_mean"),
        sd.alias("trailing_sd"), F.col("n").alias("trailing_days"),
        F.coalesce((F.col("n") >= 2) & (F.col("spend") > mean + F.lit(sigmas) * sd), F.lit(False)).alias("is_anomaly"))


# The states in which a cluster counts as active.
ACTIVE_STATES = ("STARTING", "BOOTSTRAPPING", "RUNNING", "WAITING")


def cluster_run_cost(runs: DataFrame, as_of: datetime, rate: str = "1.5", name_prefix: str | None = None,
                     states: tuple[str, ...] | None = ACTIVE_STATES) -> DataFrame:
    """Hours since creation, hours x rate, long-running flags of the
    active clusters whose name starts with ``name_prefix``."""
    if name_prefix:
        runs = runs.where(F.col("name").startswith(name_prefix))
    if states:
        runs = runs.where(F.col("state").isin(list(states)))
    micros = (F.unix_micros(ts_lit(as_of).cast("timestamp"))
              - F.unix_micros(F.col("creation_time").cast("timestamp")))
    hour = 3_600_000_000
    t = runs.withColumn("micros", micros)
    return t.select(
        "id", "name", "state", "creation_time",
        div_round("micros", F.lit(hour), 4, in_scale=0).alias("hours"),
        div_round(F.col("micros").cast("decimal(20,0)") * F.lit(Decimal(rate)), F.lit(hour), 2,
                  in_scale=1).alias("estimated_cost"),
        (F.col("micros") > 4 * hour).alias("over_4h"),
        (F.col("micros") > 8 * hour).alias("over_8h"))
