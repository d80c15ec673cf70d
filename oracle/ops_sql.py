"""Oracle SQL for the operational operators."""

from __future__ import annotations

from oracle.sqlkit import avg, dbl2dec, div, money

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
AS_OF_DATE = "DATE '2024-01-31'"

OPS_BASE = f"""
cost_lines AS (SELECT CAST(ts AS DATE) AS date, event_type AS service, {dbl2dec('value', 18, 6)} AS amount,
                      'p' || CAST(user_id % 2 AS VARCHAR) AS project FROM events),
audit_events AS (SELECT ts AS eventTime, event_type AS eventName, '10.0.0.' || CAST(user_id AS VARCHAR) AS sourceIPAddress,
                        'User' AS identity_type, event_id FROM events),
span_base AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS trace_id, event_id AS span_id,
                     event_type AS operation_name, 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service_name,
                     ts AS start_time, {dbl2dec('value')} AS duration_ms,
                     CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, props AS tags FROM events),
span_roots AS (SELECT trace_id, min({{'t': start_time, 's': span_id}}).s AS root_span_id FROM span_base GROUP BY trace_id),
spans AS (SELECT b.*, CASE WHEN b.span_id = r.root_span_id THEN NULL ELSE r.root_span_id END AS parent_span_id
          FROM span_base b LEFT JOIN span_roots r USING (trace_id)),
metrics_t AS (SELECT event_type AS name, {dbl2dec('value')} AS value, ts AS timestamp, user_id FROM events),
objects AS (SELECT source AS bucket, doc_id AS key, n_chars AS size,
                   CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS storage_class,
                   CAST(doc_id % 400 AS INTEGER) AS age_days,
                   CASE doc_id % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'clean' WHEN 2 THEN 'analytics' WHEN 3 THEN 'query-results' END AS layer,
                   doc_id % 11 = 0 AS is_delete_marker FROM documents),
cluster_runs AS (SELECT event_id AS id, 'cluster-' || CAST(user_id AS VARCHAR) AS name, 'WAITING' AS state,
                        ts AS creation_time FROM events WHERE event_type = 'view'),
task_runs AS (SELECT event_id AS task, user_id AS module,
                     CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'completed'
                                     WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' END AS status,
                     ts, {dbl2dec('value')} AS result FROM events),
stacks AS (SELECT 'stack-' || CAST(user_id % 10 AS VARCHAR) AS stack_name,
                  CASE event_type WHEN 'view' THEN 'CREATE_COMPLETE' WHEN 'purchase' THEN 'UPDATE_COMPLETE'
                                  WHEN 'click' THEN 'UPDATE_IN_PROGRESS' WHEN 'error' THEN 'UPDATE_ROLLBACK_FAILED'
                                  ELSE 'DOES_NOT_EXIST' END AS status, ts, event_id AS check_id FROM events)"""


def window(days: int) -> str:
    return f"date >= {AS_OF_DATE} - INTERVAL {days} DAY AND date < {AS_OF_DATE}"


COST_BY_SERVICE = f"""
SELECT service, {money('sum(amount)')} AS total_cost FROM cost_lines
WHERE date >= DATE '2024-01-01' AND date < {AS_OF_DATE} GROUP BY service HAVING sum(amount) > 0"""

COST_DAILY_TREND = f"""
SELECT date, {money('sum(amount)')} AS daily_cost FROM cost_lines WHERE {window(7)} GROUP BY date"""

COST_SUMMARY = f"""
SELECT DATE '2024-01-24' AS period_start, {AS_OF_DATE} AS period_end,
       {money('coalesce(sum(amount), 0)')} AS total_cost,
       {div('coalesce(sum(amount), 0)', '7', 2, ns=6, ds=0)} AS daily_average,
       count(DISTINCT service) AS services
FROM cost_lines WHERE {window(7)}"""

TOP_SERVICES = f"""
SELECT service, {money('exact')} AS total_cost FROM (SELECT service, sum(amount) AS exact FROM cost_lines WHERE {window(7)}
               GROUP BY service ORDER BY exact DESC, service LIMIT 10) t
WHERE exact > 0.01"""

COST_MTD = f"""
SELECT DATE '2024-01-01' AS month_start, {money('coalesce(sum(amount), 0)')} AS blended_total, 'p0' AS project,
       {money("coalesce(sum(CASE WHEN project = 'p0' THEN amount END), 0)")} AS project_total
FROM cost_lines WHERE date >= DATE '2024-01-01' AND date < {AS_OF_DATE}"""

DAILY_ALERT = f"""
per_ds AS (SELECT date, service, sum(amount) AS cost FROM cost_lines GROUP BY date, service),
per_d AS (SELECT date, sum(cost) AS exact,
                 coalesce(string_agg(service || ':' || CAST({money('cost')} AS VARCHAR), ', ' ORDER BY cost DESC, service)
                          FILTER (WHERE cost > 0.01), '') AS breakdown
          FROM per_ds GROUP BY date)"""

DAILY_ALERT_SELECT = f"""
SELECT date, {money('exact')} AS total_cost, CAST(10 AS DECIMAL(18,2)) AS threshold,
       {money('greatest(exact - 10, 0)')} AS overage, exact > 10 AS alert, breakdown FROM per_d"""

BUDGET_RUNNING = f"""
daily AS (SELECT date, sum(amount) AS spend FROM cost_lines GROUP BY date),
run AS (SELECT date, spend, sum(spend) OVER (PARTITION BY date_trunc('month', date) ORDER BY date
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mtd FROM daily)"""

BUDGET_RUNNING_SELECT = f"""
SELECT date, {money('spend')} AS daily_cost, {money('mtd')} AS month_to_date,
       {div('mtd', '100', 2, ns=6, ds=0, factor=100)} AS pct_of_limit,
       mtd > 80 AND mtd - spend <= 80 AS crosses_80, mtd > 100 AND mtd - spend <= 100 AS crosses_100
FROM run"""

BUDGET_STATUS = f"""
a AS (SELECT coalesce(sum(amount), 0) AS actual FROM cost_lines
      WHERE date >= DATE '2024-01-01' AND date < {AS_OF_DATE})"""

BUDGET_STATUS_SELECT = f"""
SELECT DATE '2024-01-01' AS month_start, CAST(100 AS DECIMAL(18,2)) AS budget_limit, {money('actual')} AS actual,
       {div('actual', '100', 2, ns=6, ds=0, factor=100)} AS pct_used,
       {div('actual', '30', 2, ns=6, ds=0, factor=31)} AS forecast,
       actual > 80 AS actual_80, actual > 100 AS actual_100, actual * 31 > 3000 AS forecast_100
FROM a"""

ANOMALY = f"""
daily AS (SELECT service, date, sum(amount) AS spend FROM cost_lines GROUP BY service, date),
t AS (SELECT service, date, spend,
             sum(spend) OVER w AS s, count(spend) OVER w AS n, stddev_samp(spend) OVER w AS sd
      FROM daily WINDOW w AS (PARTITION BY service ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
t2 AS (SELECT *, {div('s', 'n', 2, ns=6, ds=0)} AS trailing_mean, CAST(round(sd, 4) AS DECIMAL(18,4)) AS trailing_sd FROM t)"""

ANOMALY_SELECT = f"""
SELECT service, date, {money('spend')} AS daily_cost, trailing_mean, trailing_sd, n AS trailing_days,
       coalesce(n >= 2 AND spend > trailing_mean + 3 * trailing_sd, false) AS is_anomaly
FROM t2"""

CLUSTER_COST = f"""
r AS (SELECT *, epoch_us({AS_OF}) - epoch_us(creation_time) AS micros FROM cluster_runs)"""

CLUSTER_COST_SELECT = f"""
SELECT id, name, state, creation_time, {div('micros', '3600000000', 4, ns=0, ds=0)} AS hours,
       {div('micros * 1.5', '3600000000', 2, ns=1, ds=0)} AS estimated_cost,
       micros > 4 * 3600000000 AS over_4h, micros > 8 * 3600000000 AS over_8h
FROM r WHERE starts_with(name, 'cluster-')"""

AUDIT_RECENT = f"""
SELECT eventTime, eventName, sourceIPAddress, identity_type, event_id FROM audit_events
WHERE eventTime >= {AS_OF} - INTERVAL 1 HOUR AND eventTime < {AS_OF}"""


def security_counts(hours: int) -> str:
    return f"""
SELECT n.eventName, CAST(coalesce(c.event_count, 0) AS BIGINT) AS event_count
FROM (VALUES ('error'), ('signup'), ('purchase'), ('create_user'), ('delete_bucket')) n(eventName)
LEFT JOIN (SELECT eventName, count(*) AS event_count FROM audit_events
           WHERE eventTime >= {AS_OF} - INTERVAL {hours} HOUR AND eventTime < {AS_OF}
           GROUP BY eventName) c USING (eventName)"""


SPAN_METRICS = """
SELECT 'strata' AS namespace, span_id, trace_id, operation_name, service_name, status, epoch_us(start_time) // 1000 AS epoch_ms, 'OperationDuration' AS metric_name,
       CAST(duration_ms AS DECIMAL(12,2)) AS value, 'Milliseconds' AS unit, CAST(NULL AS VARCHAR) AS error_kind FROM spans
UNION ALL
SELECT 'strata', span_id, trace_id, operation_name, service_name, status, epoch_us(start_time) // 1000, 'OperationErrors', CAST(1 AS DECIMAL(12,2)), 'Count',
       coalesce(json_extract_string(tags, '$.k'), 'Unknown')
FROM spans WHERE status = 'error'"""

TRACE_SUMMARY = """
SELECT trace_id, count(*) AS span_count, count(CASE WHEN status = 'error' THEN 1 END) AS error_count,
       CAST(max(CASE WHEN parent_span_id IS NULL THEN duration_ms END) AS DECIMAL(12,2)) AS total_duration_ms,
       min(start_time) AS trace_start, max(start_time) AS trace_end,
       min({'t': start_time, 's': span_id, 'o': operation_name}).o AS first_operation,
       min({'t': start_time, 's': span_id, 'o': service_name}).o AS service_name,
       CASE WHEN count(CASE WHEN status = 'error' THEN 1 END) > 0 THEN 'error' ELSE 'ok' END AS status
FROM spans GROUP BY trace_id"""

# Covered time: islands of overlapping children, each clipped to its parent.
SPAN_ISLANDS = """
ranged AS (SELECT *, epoch_us(start_time) AS s, epoch_us(start_time) + CAST(duration_ms * 1000 AS BIGINT) AS e FROM spans),
clipped AS (SELECT p.trace_id, p.span_id, greatest(c.s, p.s) AS s, least(c.e, p.e) AS e FROM ranged c
            JOIN ranged p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE greatest(c.s, p.s) < least(c.e, p.e)),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY trace_id, span_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM clipped),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY trace_id, span_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
covered AS (SELECT trace_id, span_id, sum(len) AS us FROM (SELECT trace_id, span_id, island, max(e) - min(s) AS len FROM islands GROUP BY ALL) GROUP BY ALL)"""

SPAN_PARENTING = """
SELECT s.span_id, s.trace_id, s.parent_span_id, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
       CAST(s.duration_ms - CAST(coalesce(c.us, 0) AS DECIMAL(20,3)) / 1000 AS DECIMAL(18,3)) AS self_time_ms,
       s.parent_span_id IS NOT NULL AND p.span_id IS NULL AS is_orphan
FROM spans s
LEFT JOIN (SELECT trace_id, parent_span_id, count(*) AS n_children FROM spans
           WHERE parent_span_id IS NOT NULL GROUP BY ALL) k ON s.trace_id = k.trace_id AND s.span_id = k.parent_span_id
LEFT JOIN covered c ON c.trace_id = s.trace_id AND c.span_id = s.span_id
LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM spans) p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id"""

STACK_HEALTH = """
SELECT stack_name, status, checked_at,
       CAST(CASE WHEN status IN ('CREATE_COMPLETE', 'UPDATE_COMPLETE') THEN 1
                 WHEN status LIKE '%IN_PROGRESS%' THEN 0.5
                 WHEN status LIKE '%FAILED%' OR status LIKE '%ROLLBACK%' THEN 0
                 WHEN status = 'DOES_NOT_EXIST' THEN -1 ELSE 0 END AS DECIMAL(3,1)) AS health
FROM (SELECT stack_name, max({'t': ts, 'i': check_id, 's': status}).s AS status, max(ts) AS checked_at
      FROM stacks GROUP BY stack_name) x"""

METRIC_ALARM = """
SELECT date_trunc('day', timestamp) AS period_start, 'strata' AS namespace, name, 'service=svc-' || (user_id % 5) AS dimensions, max(value) AS max_value,
       CAST(450 AS DECIMAL(12,2)) AS threshold, max(value) > 450 AS alarm
FROM metrics_t GROUP BY 1, 3, 4"""

ALARM_CONSECUTIVE = """
hourly AS (SELECT name, 'service=svc-' || (user_id % 5) AS dimensions, date_trunc('hour', timestamp) AS hour, max(value) AS max_value FROM metrics_t GROUP BY ALL),
bounds AS (SELECT name, dimensions, min(hour) AS lo, max(hour) AS hi FROM hourly GROUP BY ALL),
grid AS (SELECT name, dimensions, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM bounds),
g AS (SELECT grid.*, h.max_value, CAST(coalesce(h.max_value > 250, false) AS INTEGER) AS breach FROM grid LEFT JOIN hourly h USING (name, dimensions, hour)),
alarms AS (
  SELECT 'strata' AS namespace, name, dimensions, hour, max_value, CAST(breach AS BOOLEAN) AS breaching,
         sum(breach) OVER (PARTITION BY name, dimensions ORDER BY hour ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 AS in_alarm FROM g)"""

ALARM_CONSECUTIVE_SELECT = "SELECT * FROM alarms"

# What the watermark has closed, and the first silent hour after the last sample.
STREAM_ALARM = """
SELECT *, false AS silent FROM alarms WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(timestamp)) - INTERVAL 10 MINUTE FROM metrics_t)
UNION ALL
SELECT 'strata', name, dimensions, hi + INTERVAL 1 HOUR, NULL, false, false, true FROM bounds
WHERE hi + INTERVAL 2 HOUR <= (SELECT date_trunc('millisecond', max(timestamp)) - INTERVAL 10 MINUTE FROM metrics_t)"""

STORAGE_BY_CLASS = """
SELECT bucket, coalesce(storage_class, 'STANDARD') AS storage_class, count(*) AS object_count,
       CAST(sum(size) AS BIGINT) AS total_size FROM objects GROUP BY 1, 2"""

VERSION_COUNTS = """
SELECT bucket, count(CASE WHEN NOT is_delete_marker THEN 1 END) AS versions, count(CASE WHEN is_delete_marker THEN 1 END) AS delete_markers,
       count(CASE WHEN NOT is_delete_marker THEN 1 END) AS live_versions FROM objects GROUP BY bucket"""

LIFECYCLE = """
rules(layer, after_days, action, target) AS (VALUES
  ('raw', 0, 'transition', 'INTELLIGENT_TIERING'), ('clean', 30, 'transition', 'STANDARD_IA'), ('clean', 90, 'transition', 'GLACIER'),
  ('analytics', 60, 'transition', 'STANDARD_IA'), ('analytics', 180, 'transition', 'GLACIER'), ('query-results', 30, 'expire', 'EXPIRED')),
aged AS (SELECT * REPLACE (CAST(date_diff('day', DATE '2024-01-31' - age_days, DATE '2024-01-31') AS INTEGER) AS age_days) FROM objects),
due AS (
  SELECT a.*, coalesce(r.target, 'STANDARD') AS target_tier, coalesce(r.action, 'none') AS action
  FROM aged a LEFT JOIN rules r ON r.layer = a.layer AND r.after_days = (SELECT max(after_days) FROM rules x WHERE x.layer = a.layer AND x.after_days <= a.age_days))"""

LIFECYCLE_TIER = "SELECT bucket, key, layer, age_days, target_tier, action FROM due"

LIFECYCLE_SUMMARY = """
SELECT layer, target_tier, action, count(*) AS object_count, CAST(sum(size) AS BIGINT) AS total_size FROM due GROUP BY ALL"""

LOG_RETENTION = """
SELECT CASE WHEN age_days > 7 THEN 'delete' WHEN age_days > 3 THEN 'compress' ELSE 'keep' END AS action,
       count(*) AS object_count, CAST(sum(size) AS BIGINT) AS total_size FROM objects GROUP BY 1"""

TASK_REPORT = """
SELECT *, CASE WHEN total_tasks > 0 THEN CAST(completed * 100 // total_tasks AS BIGINT) ELSE 0 END AS success_rate
FROM (SELECT count(*) AS total_tasks, count(CASE WHEN status = 'completed' THEN 1 END) AS completed,
             count(CASE WHEN status = 'failed' THEN 1 END) AS failed,
             count(CASE WHEN status = 'running' THEN 1 END) AS running,
             count(CASE WHEN status = 'pending' THEN 1 END) AS pending,
             count(CASE WHEN status = 'skipped' THEN 1 END) AS skipped FROM task_runs) a"""

TASK_DETAILS = """
SELECT task, '{' || concat_ws(',', '"task":' || task, '"module":' || module, '"status":"' || status || '"', '"result":' || result) || '}' AS detail
FROM task_runs"""

LOG_OBJECTS = """
SELECT bucket, name, age_days, CASE WHEN NOT (name LIKE '%.log' OR name LIKE '%.gz') THEN 'keep' WHEN age_days > 7 THEN 'delete'
  WHEN age_days > 3 AND name LIKE '%.log' THEN 'compress' ELSE 'keep' END AS action
FROM (SELECT bucket, 'log-' || key || CASE key % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.gz' ELSE '.txt' END AS name,
             CAST(date_diff('day', DATE '2024-01-31' - age_days, DATE '2024-01-31') AS INTEGER) AS age_days FROM objects)"""

TRACE_SPANS = """
SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS position, span_id, service_name, operation_name
FROM spans"""

MODULE_HEALTH = """
SELECT *, CASE WHEN total_modules > 0 THEN CAST(healthy_modules * 100 // total_modules AS BIGINT) END AS health_pct
FROM (SELECT count(*) AS total_modules, count(CASE WHEN status IN ('completed') THEN 1 END) AS healthy_modules
      FROM (SELECT module, max({'t': ts, 'k': task, 's': status}).s AS status FROM task_runs GROUP BY module) l) a"""
