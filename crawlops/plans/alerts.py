"""Counters, panels, alert rules and inhibition over metric samples.

Samples are rows (event_id, ts, metric, instance, value).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlops.functions.text import private_ip
from crawlops.operators.skew import HOT_ROWS, cut_hot, done, running, trailing
from crawlops.session import cut

SERIES = ["metric", "instance"]


def with_deltas(samples: DataFrame, hot_rows: int = HOT_ROWS):
    """Growth since the previous sample of the series; after a reset the value itself."""
    pieces = running(cut_hot(samples, SERIES, ["ts", "event_id"], hot_rows), previous={"_prev": F.col("value")})
    reset = F.col("value") < F.col("_prev")
    delta = F.when(F.col("_prev").isNull(), F.lit(0.0)).when(reset, F.col("value")).otherwise(F.col("value") - F.col("_prev"))
    pieces.df = pieces.df.withColumns(
        {"delta": delta, "reset": F.when(F.coalesce(reset, F.lit(False)), 1).otherwise(0)}
    ).drop("_prev")
    return pieces


def increase(samples: DataFrame, seconds: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Counter growth, rate per second and resets in the window that ends at each sample.

    The growth is taken between samples inside the window; there is no
    extrapolation to the window's edges.
    """
    pieces = with_deltas(samples, hot_rows)
    out = trailing(pieces, seconds, {"_grown": F.col("delta"), "_resets": F.col("reset").cast("bigint")})
    grown = F.round("_grown", 6)
    return out.select(
        "event_id", *SERIES, "ts", "value", grown.alias("increase"), (grown / seconds).alias("rate"), F.col("_resets").alias("resets")
    )


def bucket_end(ts: Column, step: int) -> Column:
    """End of the step (end - step, end] a time belongs to."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_seconds(F.ceil(us / F.lit(step * 1_000_000)) * step).cast("timestamp_ntz")


def by_step(samples: DataFrame, step: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per series and step: last value, growth, growth of the first sample.

    From here on the size depends on the number of series and steps, not on the samples.
    """
    order = F.struct("ts", "event_id")
    return (
        done(with_deltas(samples, hot_rows).df)
        .groupBy(*SERIES, bucket_end(F.col("ts"), step).alias("ts"))
        .agg(
            F.max_by("value", order).alias("last"), F.sum("delta").alias("delta"),
            F.min_by("delta", order).alias("first_delta"), F.sum("reset").alias("resets"),
        )
    )


def windowed_growth(keys: list[str], seconds: int) -> Column:
    """Growth within the trailing window at each step."""
    w = Window.partitionBy(*keys).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-(seconds - 1), 0)
    return F.sum("delta").over(w) - F.first("first_delta", ignorenulls=True).over(w)


def on_grid(steps: DataFrame, step: int, keys: list[str], end: DataFrame) -> DataFrame:
    """Every step of each series from its first one to the common ``end``; empty steps grow by nothing."""
    spans = steps.groupBy(*keys).agg(F.min("ts").alias("_start")).withColumn("_end", end.scalar())
    grid = spans.select(*keys, F.explode(F.sequence("_start", "_end", F.make_dt_interval(secs=F.lit(step)))).alias("ts"))
    grown = steps.select(*keys, "ts", "delta", "first_delta")
    return grid.join(grown, [*keys, "ts"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    metrics: tuple[str, ...]
    op: str
    threshold: float
    hold: int  # seconds the condition must last
    severity: str = "warning"
    window: int = 0  # seconds


# The alert rules.
RULES = [
    Rule("ServiceDown", "last", ("up",), "=", 0, 60, "critical"),
    Rule("HighCPUUsage", "busy", ("cpu_idle_seconds",), ">", 80, 300, window=300),
    Rule("HighMemoryUsage", "used", ("mem_available", "mem_total"), ">", 90, 300, "critical"),
    Rule("DiskSpaceLow", "used", ("disk_available", "disk_total"), ">", 85, 120),
    Rule("DatabaseDown", "last", ("db_up",), "=", 0, 30, "critical"),
    Rule("TooManyDatabaseConnections", "last", ("db_connections",), ">", 80, 120),
    Rule("SlowDatabaseQueries", "rate", ("db_query_seconds",), ">", 5, 180, window=300),
    Rule("DatabaseSizeGrowthHigh", "growth", ("db_size_bytes",), ">", 1e9, 600, window=3600),
    Rule("HighJobFailureRate", "ratio", ("jobs_failed", "jobs_total"), ">", 0.2, 300, window=300),
    Rule("JobsStuck", "age", ("job_start_time",), ">", 3600, 300),
    Rule("JobQueueTooLarge", "last", ("jobs_pending",), ">", 1000, 600),
    Rule("NoJobsProcessed", "rate_on_grid", ("jobs_done",), "=", 0, 900, window=600),
    Rule("TooManyJobRetries", "last", ("job_retries",), ">", 5, 60),
    Rule("WorkerNotResponding", "age", ("worker_heartbeat",), ">", 300, 120, "critical"),
    Rule("WorkerHighMemoryUsage", "last", ("worker_memory_bytes",), ">", 2e9, 300),
    Rule("HighJobProcessingTime", "mean", ("job_duration_seconds",), ">", 1800, 600),
    Rule("LowActiveProxies", "last", ("proxies_active",), "<", 10, 300),
    Rule("LowProxySuccessRate", "mean", ("proxy_success_rate",), "<", 0.7, 600),
    Rule("HighProxyResponseTime", "mean", ("proxy_response_seconds",), ">", 10, 300),
    Rule("DashboardDown", "last", ("dashboard_up",), "=", 0, 60, "critical"),
    Rule("DashboardSlowResponse", "mean", ("page_load_seconds",), ">", 5, 300),
    Rule("TooManyDashboardUsers", "last", ("dashboard_users",), ">", 50, 600),
    Rule("LowContactExtractionRate", "rate", ("contacts_extracted",), "<", 10, 1800, window=3600),
    Rule("NoNewContacts", "growth_on_grid", ("contacts_extracted",), "=", 0, 900, window=7200),
    Rule("HighContactDuplicationRate", "ratio", ("contacts_duplicated", "contacts_extracted"), ">", 0.5, 1200, window=3600),
    Rule("SuspiciousLoginAttempts", "rate", ("logins_failed",), ">", 5, 120, window=300),
    Rule("SuspiciousIPAccess", "last_public", ("dashboard_requests",), ">", 100, 600),
]
# Fixed values: (source alert, suppressed alerts, equal labels).
INHIBITIONS = [
    ("ServiceDown", ["HighCPUUsage", "HighMemoryUsage", "DashboardSlowResponse"], ["instance"]),
    ("DatabaseDown", ["HighJobFailureRate", "JobsStuck", "NoJobsProcessed"], []),
    ("WorkerNotResponding", ["HighJobProcessingTime", "NoJobsProcessed"], []),
]
EVERYWHERE = "all"


def _grown(windows: set[int], keys: list[str]) -> dict[str, Column]:
    return {f"grown_{w}": windowed_growth(keys, w) for w in sorted(windows)}


def _pick(windows: set[int]) -> Column:
    """Growth over the window of the row's rule."""
    out = F.lit(None).cast("double")
    for w in windows:
        out = F.when(F.col("window") == w, F.col(f"grown_{w}")).otherwise(out)
    return out


def evaluate(steps: DataFrame, step: int, rules: list[Rule] = RULES) -> DataFrame:
    """Measure and condition of every rule at every step with data.

    All windows share one pass over the series; the rules then split into those
    per series, over all instances, over a pair of series, and on a full grid.
    """
    grid = [r for r in rules if r.kind.endswith("_on_grid")]
    plain = [r for r in rules if r not in grid]
    rule_cols = ["alert", "kind", "window", "severity", "op", "threshold", "hold"]
    schema = "metric string, part int, alert string, kind string, window int, severity string, op string, threshold double, hold int"

    def table(chosen: list[Rule]) -> DataFrame:  # one row per rule and metric
        rows = [
            (m, i, r.name, r.kind.removesuffix("_on_grid"), r.window, r.severity, r.op, float(r.threshold), r.hold)
            for r in chosen for i, m in enumerate(r.metrics)
        ]
        return F.broadcast(steps.sparkSession.createDataFrame(rows, schema))

    def measured(df: DataFrame, measure: Column) -> DataFrame:
        return df.select(*rule_cols, "instance", "ts", F.round(measure.cast("double"), 6).alias("measure"))

    kind, last, grown, window = F.col("kind"), F.col("last"), F.col("grown"), F.col("window")
    parts = []
    if plain:
        spans = {r.window for r in plain if r.window}
        rows = steps.withColumns(_grown(spans, SERIES)).join(table(plain), "metric").withColumn("grown", _pick(spans))
        public = (kind != "last_public") | ~private_ip("instance")
        single = (
            F.when(kind.isin("last", "last_public"), last)
            .when(kind == "age", F.unix_seconds(F.col("ts").cast("timestamp")) - last)
            .when(kind == "busy", 100 - grown / window * 100)
            .when(kind == "rate", grown / window)
            .otherwise(grown)
        )
        parts.append(measured(rows.where(~kind.isin("mean", "ratio", "used") & public), single))
        of_part = [F.sum(F.when(F.col("part") == i, grown)) for i in (0, 1)]
        overall = rows.where(kind.isin("mean", "ratio")).groupBy(*rule_cols, "ts").agg(
            F.avg(last).alias("mean"), F.try_divide(*of_part).alias("ratio")
        )
        parts.append(measured(overall.withColumn("instance", F.lit(EVERYWHERE)), F.when(kind == "mean", F.col("mean")).otherwise(F.col("ratio"))))
        level = [F.max(F.when(F.col("part") == i, last)) for i in (0, 1)]
        used = rows.where(kind == "used").groupBy(*rule_cols, "instance", "ts").agg(F.try_divide(*level).alias("free"))
        parts.append(measured(used, (1 - F.col("free")) * 100))
    if grid:
        spans = {r.window for r in grid}
        own = steps.join(table(grid).select("metric").distinct(), "metric", "left_semi")
        full = on_grid(own, step, SERIES, steps.agg(F.max("ts").alias("_end")))
        rows = full.withColumns(_grown(spans, SERIES)).join(table(grid), "metric").withColumn("grown", _pick(spans))
        parts.append(measured(rows, F.when(kind == "rate", grown / window).otherwise(grown)))
    measure, op, limit = F.col("measure"), F.col("op"), F.col("threshold")
    cond = F.when(op == ">", measure > limit).when(op == "<", measure < limit).otherwise(measure == limit)
    return functools.reduce(DataFrame.unionByName, parts).where(measure.isNotNull()).withColumn("cond", cond)


def sustained(df: DataFrame, keys: list[str], hold: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose condition is true, with the begin of the unbroken true run and its state.

    ``df`` has ts and cond; the state is firing once the run has lasted ``hold`` seconds.
    """
    pieces = running(cut_hot(df, keys, ["ts"], hot_rows), previous={"_before": F.col("cond")})
    begins = F.col("cond") & ~F.coalesce("_before", F.lit(False))
    pieces = running(pieces, maxes={"active_since": F.when(begins, F.col("ts"))})
    lasted = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("active_since").cast("timestamp"))
    return (
        done(pieces.df).drop("_before").where("cond")
        .withColumn("state", F.when(lasted >= hold.cast("bigint") * 1_000_000, "firing").otherwise("pending"))
    )


def inhibit(alerts: DataFrame, rules=None) -> DataFrame:
    """Alerts without those whose source alert fires at the same time on equal labels."""
    out = alerts
    for source, targets, equal in rules or INHIBITIONS:
        firing = alerts.where((F.col("alert") == source) & (F.col("state") == "firing")).select("ts", *equal).distinct()
        hit = firing.withColumn("_hit", F.lit(True))
        out = (
            out.join(hit, ["ts", *equal], "left")
            .where(~(F.coalesce("_hit", F.lit(False)) & F.col("alert").isin(*targets)))
            .drop("_hit")
        )
    return out


def alerts(samples: DataFrame, step: int = 300, rules: list[Rule] = RULES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pending and firing alerts after inhibition."""
    measured = cut(evaluate(cut(by_step(samples, step, hot_rows)), step, rules))
    held = cut(sustained(measured, ["alert", "instance"], F.col("hold"), hot_rows))
    return inhibit(held).select("alert", "severity", "instance", "ts", "measure", "active_since", "state")


# Panels that relate two series or a rate to its most.
RATIO_PANELS = [
    Rule("cpu_busy", "busy", ("cpu_idle_seconds",), ">", 0, 0, window=300), Rule("memory_used", "used", ("mem_available", "mem_total"), ">", 0, 0),
    Rule("disk_used", "used", ("disk_available", "disk_total"), ">", 0, 0),
]


def ratio_panels(samples: DataFrame, step: int = 300, shown: list[Rule] = RATIO_PANELS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Panel series in percent per instance and step."""
    measured = evaluate(by_step(samples, step, hot_rows), step, shown)
    return measured.select(F.col("alert").alias("panel"), "instance", "ts", F.col("measure").alias("percent"))


def panels(samples: DataFrame, step: int = 3600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Panel series per step: last value, growth in the last hour and its five-minute equivalent."""
    steps = by_step(samples, step, hot_rows)
    grown = windowed_growth(SERIES, 3600)
    shown = F.when(F.col("metric").endswith("_bytes"), F.col("last") / (1024 * 1024)).otherwise(F.col("last"))
    return steps.select(
        *SERIES, "ts", F.round(shown, 6).alias("shown"), F.round(grown, 6).alias("growth_1h"),
        F.round(grown / 3600 * 300, 6).alias("per_5m"), "resets",
    )
