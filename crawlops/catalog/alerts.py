"""Counters, panels, alert rules and inhibition with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlops.catalog.registry import query
from crawlops.plans import alerts

STEP = 3600
SERIES = "PARTITION BY metric, instance ORDER BY"
DELTAS = f"""p AS (SELECT *, lag(value) OVER ({SERIES} ts, event_id) AS prev FROM samples ),
d AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS delta, CASE WHEN value < prev THEN 1 ELSE 0 END AS reset FROM p)"""


@query("counter_increase", f"""
WITH {DELTAS}, w AS (SELECT *, first(delta) OVER z AS fd, first(reset) OVER z AS fr, sum(delta) OVER z AS sd, sum(reset) OVER z AS sr FROM d
  WINDOW z AS ({SERIES} epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW))
SELECT event_id, metric, instance, ts, value, round(sd - fd, 6) AS increase, round(sd - fd, 6) / 86400 AS rate, CAST(sr - fr AS BIGINT) AS resets FROM w""")
def _(t):
    return alerts.increase(t.samples, 86_400)


def sql_steps(step: int) -> str:
    return f"""{DELTAS}, st AS (SELECT metric, instance, make_timestamp(CAST(ceil(epoch_us(ts) / {step}000000) AS BIGINT) * {step}000000) AS ts, arg_max(value, (ts, event_id)) AS last,
  sum(delta) AS delta, arg_min(delta, (ts, event_id)) AS first_delta, CAST(sum(reset) AS BIGINT) AS resets FROM d GROUP BY ALL)"""


def sql_grown(seconds: int, source: str) -> str:
    w = f"(PARTITION BY metric, instance ORDER BY epoch(ts) RANGE BETWEEN {seconds - 1} PRECEDING AND CURRENT ROW)"
    return f"(SELECT *, sum(delta) OVER {w} - first(first_delta IGNORE NULLS) OVER {w} AS grown FROM {source})"


@query("panel_series", f"""
WITH {sql_steps(STEP)}
SELECT metric, instance, ts, round(CASE WHEN metric LIKE '%\\_bytes' ESCAPE '\\' THEN last / 1048576 ELSE last END, 6) AS shown, round(grown, 6) AS growth_1h,
  round(grown / 3600 * 300, 6) AS per_5m, resets FROM {sql_grown(3600, 'st')}""")
def _(t):
    return alerts.panels(t.samples, STEP)


SHOWN = [alerts.Rule(r.name, r.kind, r.metrics, r.op, r.threshold, r.hold, window=86_400 if r.window else 0) for r in alerts.RATIO_PANELS]


GRID = f"""gr AS (SELECT s.metric, s.instance, unnest(generate_series(s.a, (SELECT max(ts) FROM st), INTERVAL {STEP} SECOND)) AS ts FROM (SELECT metric, instance, min(ts) AS a FROM st GROUP BY 1, 2) s),
full_st AS (SELECT gr.metric, gr.instance, gr.ts, coalesce(st.delta, 0) AS delta, st.first_delta FROM gr LEFT JOIN st ON st.metric = gr.metric AND st.instance = gr.instance AND st.ts = gr.ts)"""


def sql_measure(r: alerts.Rule) -> str:
    names = "(" + ", ".join(f"'{m}'" for m in r.metrics) + ")"
    a, b = r.metrics[0], r.metrics[-1]
    grown = sql_grown(r.window or 1, f"(SELECT * FROM {'full_st' if r.kind.endswith('_on_grid') else 'st'} WHERE metric IN {names})")
    return {
        "last": f"SELECT instance, ts, last AS m FROM st WHERE metric = '{a}'",
        "last_public": f"SELECT instance, ts, last AS m FROM st WHERE metric = '{a}' AND NOT regexp_matches(instance, '^(192\\.168\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|127\\.)')",
        "age": f"SELECT instance, ts, epoch(ts) - last AS m FROM st WHERE metric = '{a}'",
        "mean": f"SELECT 'all' AS instance, ts, avg(last) AS m FROM st WHERE metric = '{a}' GROUP BY ts",
        "used": f"SELECT x.instance, x.ts, (1 - x.last / y.last) * 100 AS m FROM st x JOIN st y ON x.instance = y.instance AND x.ts = y.ts WHERE x.metric = '{a}' AND y.metric = '{b}'",
        "busy": f"SELECT instance, ts, 100 - grown / {r.window} * 100 AS m FROM {grown}",
        "rate": f"SELECT instance, ts, grown / {r.window} AS m FROM {grown}",
        "rate_on_grid": f"SELECT instance, ts, grown / {r.window} AS m FROM {grown}",
        "growth": f"SELECT instance, ts, grown AS m FROM {grown}",
        "growth_on_grid": f"SELECT instance, ts, grown AS m FROM {grown}",
        "ratio": f"""SELECT 'all' AS instance, ts, sum(grown) FILTER (WHERE metric = '{a}') / nullif(sum(grown) FILTER (WHERE metric = '{b}'), 0) AS m FROM {grown} GROUP BY ts""",
    }[r.kind]


@query("panel_ratios", f"""
WITH {sql_steps(STEP)} SELECT panel, instance, ts, round(CAST(m AS DOUBLE), 6) AS percent FROM (
  SELECT 'cpu_busy' AS panel, instance, ts, 100 - grown / 86400 * 100 AS m FROM {sql_grown(86400, "(SELECT * FROM st WHERE metric = 'cpu_idle_seconds')")}
  UNION ALL SELECT 'memory_used', x.instance, x.ts, (1 - x.last / y.last) * 100 FROM st x JOIN st y ON x.instance = y.instance AND x.ts = y.ts WHERE x.metric = 'mem_available' AND y.metric = 'mem_total'
  UNION ALL SELECT 'disk_used', x.instance, x.ts, (1 - x.last / y.last) * 100 FROM st x JOIN st y ON x.instance = y.instance AND x.ts = y.ts WHERE x.metric = 'disk_available' AND y.metric = 'disk_total')
WHERE m IS NOT NULL""")
def _(t):
    return alerts.ratio_panels(t.samples, STEP, SHOWN)


# windows and holding times stretched to the hourly steps of the given events
RULES = [
    alerts.Rule(r.name, r.kind, r.metrics, r.op, r.threshold, r.hold * 24, r.severity, max(r.window, STEP) * 24 if r.window else 0)
    for r in alerts.RULES
]
MEASURES = " UNION ALL ".join(
    f"SELECT '{r.name}' AS alert, '{r.severity}' AS severity, instance, ts, round(CAST(m AS DOUBLE), 6) AS measure, round(CAST(m AS DOUBLE), 6) {r.op} {float(r.threshold)}::DOUBLE AS cond, {r.hold} AS hold FROM ({sql_measure(r)}) WHERE m IS NOT NULL"
    for r in RULES
)
HELD = f"""ms AS ({MEASURES}), c AS (SELECT *, lag(cond) OVER (PARTITION BY alert, instance ORDER BY ts) AS b4 FROM ms),
s AS (SELECT *, max(CASE WHEN cond AND NOT coalesce(b4, FALSE) THEN ts END) OVER (PARTITION BY alert, instance ORDER BY ts) AS active_since FROM c),
h AS (SELECT alert, severity, instance, ts, measure, active_since, CASE WHEN epoch_us(ts) - epoch_us(active_since) >= hold::BIGINT * 1000000 THEN 'firing' ELSE 'pending' END AS state FROM s WHERE cond)"""
INHIBITED = """SELECT h.* FROM h WHERE NOT (alert IN ('HighCPUUsage', 'HighMemoryUsage', 'DashboardSlowResponse') AND EXISTS (SELECT 1 FROM h s WHERE s.alert = 'ServiceDown' AND s.state = 'firing' AND s.ts = h.ts AND s.instance = h.instance))
  AND NOT (alert IN ('HighJobFailureRate', 'JobsStuck', 'NoJobsProcessed') AND EXISTS (SELECT 1 FROM h s WHERE s.alert = 'DatabaseDown' AND s.state = 'firing' AND s.ts = h.ts))
  AND NOT (alert IN ('HighJobProcessingTime', 'NoJobsProcessed') AND EXISTS (SELECT 1 FROM h s WHERE s.alert = 'WorkerNotResponding' AND s.state = 'firing' AND s.ts = h.ts))"""


def held(t):
    steps = alerts.by_step(t.samples, STEP)
    measured = alerts.cut(alerts.evaluate(alerts.cut(steps), STEP, RULES))
    return alerts.sustained(measured, ["alert", "instance"], F.col("hold"))


@query("sustained", f"WITH {sql_steps(STEP)}, {GRID}, {HELD} SELECT * FROM h")
def _(t):
    return held(t).select("alert", "severity", "instance", "ts", "measure", "active_since", "state")


@query("alerts", f"WITH {sql_steps(STEP)}, {GRID}, {HELD} {INHIBITED}")
def _(t):
    return alerts.alerts(t.samples, STEP, RULES)


SIMPLE_ALERTS = """SELECT event_id, ts, concat('n', CAST(user_id % 3 AS STRING)) AS instance, CASE WHEN event_id % 2 = 0 THEN 'firing' ELSE 'pending' END AS state,
  CASE floor(event_id / 7) % 4 WHEN 0 THEN 'ServiceDown' WHEN 1 THEN 'HighCPUUsage' WHEN 2 THEN 'DatabaseDown' ELSE 'JobsStuck' END AS alert FROM {events}"""


@query("alert_inhibit", f"""
WITH h AS (SELECT event_id, instance, state, alert, date_trunc('hour', ts) AS ts FROM ({SIMPLE_ALERTS.format(events='events')})) {INHIBITED}""")
def _(t):
    rows = t.spark.sql(SIMPLE_ALERTS, events=t.events)
    hourly = rows.withColumn("ts", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    return alerts.inhibit(hourly).select("event_id", "instance", "state", "alert", "ts")
