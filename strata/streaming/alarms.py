"""Alarms over consecutive periods as a running job.

The state of a metric (namespace, name, dimensions) is what its next period
needs: the last closed period, how many periods up to it breached without a
gap, and the maxima of the periods that the watermark has not closed yet.  A
period is closed when the watermark passes its end; then its row is written,
and rows for the periods in which the metric was silent before it.  Event-time
timers close periods of metrics that send nothing more, and report the first
silent period after the last sample, which ends an alarm.

Over the periods that are closed the result equals ``alarm_consecutive`` over
the same samples.  State lies in the checkpoint, so a job that is started again
goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strata.operators.telemetry import METRIC, dimension_text

_STATE = "closed bigint, streak int, silent boolean, open array<bigint>, tops array<bigint>"
_OUT = "namespace string, name string, dimensions string, period bigint, top bigint, breaching boolean, in_alarm boolean, silent boolean"
PERIOD_MS = {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def closed_rows(closed: int | None, streak: int, silent: bool, tops: dict[int, int], until: int, limit: int, periods: int) -> tuple[list[tuple], tuple]:
    """Rows (period, top, breaching, in_alarm, silent) of the periods below
    ``until``, and the state after them.

    ``closed`` is the last period that a row was written for (None: none yet);
    ``tops`` the maxima of open periods, in hundredths, like ``limit``.
    """
    rows, left = [], dict(tops)
    for k in sorted(tops):
        if closed is not None:
            for gap in range(closed + 1, min(k, until)):
                rows.append((gap, None, False, False, False))
                closed, streak = gap, 0
        if k >= until:
            break
        breach = tops[k] > limit
        streak = min(streak + 1, periods) if breach else 0
        rows.append((k, left.pop(k), breach, streak >= periods, False))
        closed, silent = k, False
    if not left and closed is not None and not silent and closed + 1 < until:
        rows.append((closed + 1, None, False, False, True))
        closed, streak, silent = closed + 1, 0, True
    return rows, (closed, streak, silent, left)


def alarm_stream(metrics: DataFrame, threshold: str, periods: int = 4, period: str = "hour", delay: str = "10 minutes") -> DataFrame:
    """(namespace, name, dimensions, <period>, max_value, breaching, in_alarm,
    silent) of a stream of metric samples, a row a closed period."""
    ms, limit = PERIOD_MS[period], int(round(float(threshold) * 100))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, streak, silent, tops = None, 0, False, {}
        if state.exists:
            closed, streak, silent, ks, vs = state.get
            closed = None if closed < 0 else closed
            tops = dict(zip(ks, vs))
        for f in frames:
            for k, v in f.groupby("period")["top"].max().items():
                if closed is None or k > closed:
                    tops[int(k)] = max(int(v), tops.get(int(k), int(v)))
        water = state.getCurrentWatermarkMs()
        rows, (closed, streak, silent, tops) = closed_rows(closed, streak, silent, tops, water // ms, limit, periods)
        state.update((-1 if closed is None else closed, streak, silent, list(tops), list(tops.values())))
        # The timer: the end of the first open period, or of the one whose silence is to be told.
        due = min(tops) + 1 if tops else None if silent or closed is None else closed + 2
        if due is not None:
            state.setTimeoutTimestamp(max(due * ms, water + 1))
        if rows:
            out = pd.DataFrame(rows, columns=["period", "top", "breaching", "in_alarm", "silent"])
            out["top"] = out["top"].astype("Int64")
            for name, value in zip(METRIC, key):
                out[name] = value
            yield out[[*METRIC, "period", "top", "breaching", "in_alarm", "silent"]]

    at = F.col("timestamp").cast("timestamp")
    samples = metrics.select("namespace", "name", dimension_text().alias("dimensions"), at.alias("timestamp"),
                             F.floor(F.unix_millis(at) / ms).alias("period"), (F.col("value") * 100).cast("bigint").alias("top"))
    samples = samples.where("top IS NOT NULL AND timestamp IS NOT NULL").withWatermark("timestamp", delay)
    rows = samples.groupBy(*METRIC).applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    start = F.timestamp_millis(F.col("period") * ms).cast("timestamp_ntz")
    return rows.select(*METRIC, start.alias(period), (F.col("top").cast("decimal(14,0)") / 100).cast("decimal(12,2)").alias("max_value"), "breaching", "in_alarm", "silent")
