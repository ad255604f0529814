"""Operational reports: one conditional aggregate per table."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlops.operators.filters import live
from crawlops.session import at, seconds_between


def bundle(*rows: DataFrame) -> DataFrame:
    """Several one-row results side by side in one row."""
    table = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return table.agg(*[F.max(c).alias(c) for c in table.columns])


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def avg_if(value: str, cond: Column | None = None, digits: int = 6) -> Column:
    col = F.col(value).cast("double")
    return F.round(F.avg(col if cond is None else F.when(cond, col)), digits)


def status_is(value: str) -> Column:
    return F.col("status") == value


def on_day(ts: str, as_of) -> Column:
    """The time lies on the reference day; written as a range so that it can be pushed down."""
    day = F.to_date(at(as_of)).cast("timestamp_ntz")
    return (F.col(ts) >= day) & (F.col(ts) < day + F.expr("INTERVAL '1' DAY"))


def _job_counts(queue: DataFrame, as_of, running: str, done: str, failed: str | None) -> DataFrame:
    cols = [
        count_if(status_is("pending")).alias("pending_jobs"),
        count_if(status_is("in_progress")).alias(running),
        count_if(status_is("done") & on_day("updated_at", as_of)).alias(done),
    ]
    if failed:
        cols.append(count_if(status_is("failed") & on_day("updated_at", as_of)).alias(failed))
    return queue.agg(*cols)


def _contact_counts(contacts: DataFrame, as_of) -> DataFrame:
    return contacts.agg(
        count_if(on_day("created_at", as_of)).alias("contacts_today"),
        count_if(F.col("verified")).alias("verified_contacts"),
        F.countDistinct("country").alias("countries_covered"),
    )


def _session_counts(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        count_if(F.col("active")).alias("active_sessions"),
        count_if(F.col("validation_status") == "valid").alias("valid_sessions"),
    )


def usable(as_of) -> Column:
    return F.col("active") & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") < at(as_of)))


def overview_v1(queue, contacts, proxies, sessions, as_of) -> DataFrame:
    """Twelve counts and averages; soft-deleted rows count here."""
    pool = proxies.agg(
        count_if(F.col("active")).alias("active_proxies"),
        avg_if("response_time_ms", F.col("active") & (F.col("response_time_ms") > 0)).alias("avg_proxy_response_time"),
        avg_if("success_rate", F.col("active")).alias("avg_proxy_success_rate"),
    )
    return bundle(
        _job_counts(queue, as_of, "running_jobs", "completed_today", "failed_today"),
        _contact_counts(contacts, as_of), pool, _session_counts(sessions),
    )


def overview_v2(queue, contacts, proxies, sessions, seen, as_of) -> DataFrame:
    """The first overview with cooldowns, open breakers and the URL store."""
    pool = proxies.agg(
        count_if(usable(as_of)).alias("active_proxies"),
        avg_if("average_latency_ms", F.col("active") & (F.col("average_latency_ms") > 0)).alias("avg_proxy_response_time"),
        avg_if("success_rate", F.col("active")).alias("avg_proxy_success_rate"),
        count_if(F.col("circuit_breaker_status") == "open").alias("circuit_breaker_open"),
    )
    urls = seen.agg(
        count_if(on_day("first_seen_at", as_of)).alias("urls_seen_today"),
        count_if((F.col("processing_status") == "skipped") & (F.col("skip_reason") == "duplicate")).alias("duplicates_skipped"),
    )
    return bundle(
        _job_counts(queue, as_of, "running_jobs", "completed_today", "failed_today"),
        _contact_counts(contacts, as_of), pool, _session_counts(sessions), urls,
    )


def scheduler_stats(queue, contacts, as_of, slots: int = 3, running: int = 0, paused: bool = False) -> DataFrame:
    jobs = _job_counts(live(queue), as_of, "active_jobs", "completed_today", "failed_today")
    new = live(contacts).agg(count_if(on_day("created_at", as_of)).alias("contacts_today"))
    return bundle(jobs, new).withColumns(
        {
            "running_jobs": F.lit(running),
            "scheduler_status": F.lit("paused" if paused else "running"),
            "max_concurrent_jobs": F.lit(slots),
        }
    )


def tiles(queue, contacts, proxies, as_of) -> DataFrame:
    return bundle(
        _job_counts(live(queue), as_of, "active_jobs", "completed_jobs", None),
        live(contacts).agg(count_if(on_day("created_at", as_of)).alias("total_contacts")),
        proxies.agg(count_if(F.col("active")).alias("active_proxies")),
    )


def contact_stats(contacts, as_of) -> DataFrame:
    return live(contacts).agg(
        F.count(F.lit(1)).alias("total_contacts"),
        count_if(on_day("created_at", as_of)).alias("today_contacts"),
        count_if(F.col("verified")).alias("verified_contacts"),
        F.countDistinct("country").alias("unique_countries"),
    )


def totals(queue, contacts, proxies) -> DataFrame:
    return bundle(
        live(queue).agg(F.count(F.lit(1)).alias("total_jobs"), F.max("created_at").alias("last_job_created")),
        live(contacts).agg(F.count(F.lit(1)).alias("total_contacts")),
        proxies.agg(F.count(F.lit(1)).alias("total_proxies")),
    )


def proxy_stats_basic(proxies, max_failures: int = 5) -> DataFrame:
    return proxies.agg(
        F.count(F.lit(1)).alias("total_proxies"),
        count_if(F.col("active")).alias("active_proxies"),
        count_if(F.col("consecutive_failures") >= max_failures).alias("blocked_proxies"),
        avg_if("success_rate", F.col("active")).alias("avg_success_rate"),
        avg_if("response_time_ms", F.col("active") & (F.col("response_time_ms") > 0)).alias("avg_response_time"),
    )


def proxy_stats_full(proxies, as_of, max_failures: int = 3) -> DataFrame:
    active, now = F.col("active"), at(as_of)

    def used_within(hours: int) -> Column:
        return F.col("last_used_at") >= now - F.make_dt_interval(hours=F.lit(hours))

    return proxies.agg(
        F.count(F.lit(1)).alias("total_proxies"),
        count_if(active).alias("active_proxies"),
        count_if(usable(as_of)).alias("usable_proxies"),
        count_if(F.col("consecutive_failures") >= max_failures).alias("blocked_proxies"),
        count_if(F.col("circuit_breaker_status") == "open").alias("circuit_breaker_open"),
        count_if(F.col("circuit_breaker_status") == "half_open").alias("circuit_breaker_half_open"),
        avg_if("success_rate", active, 3).alias("avg_success_rate"),
        avg_if("average_latency_ms", active & (F.col("average_latency_ms") > 0), 1).alias("avg_response_time"),
        count_if(used_within(1)).alias("recently_used"),
        count_if(used_within(24)).alias("used_today"),
        F.countDistinct(F.when(active, F.col("country_code"))).alias("countries_available"),
        F.countDistinct(F.when(active, F.col("provider"))).alias("providers_available"),
        F.max("last_used_at").alias("last_proxy_used"),
        F.sum(F.when(active, F.col("total_requests"))).alias("total_requests_today"),
    )


def proxy_health(
    stats: DataFrame, min_usable: int = 3, min_success: float = 0.7, max_response: float = 5000, max_blocked: float = 0.5
) -> DataFrame:
    """One row per failed check of the one-row statistics, with the overall status; one ``none`` row when all pass."""
    blocked = F.try_divide(F.col("blocked_proxies").cast("double"), F.col("total_proxies"))

    def check(cond: Column, name: str, status: str, current, threshold) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(name).alias("check_name"), F.lit(status).alias("check_status"),
                current.cast("double").alias("current"), F.lit(threshold).cast("double").alias("threshold"),
            ),
        )

    rate, time = F.col("avg_success_rate"), F.col("avg_response_time")
    checks = F.array_compact(
        F.array(
            check(F.col("usable_proxies") < min_usable, "usable_proxies", "warning", F.col("usable_proxies"), min_usable),
            check((rate != 0) & (rate < min_success), "success_rate", "warning", rate, min_success),
            check((time != 0) & (time > max_response), "response_time", "warning", time, max_response),
            check(blocked > max_blocked, "blocked_ratio", "critical", blocked, max_blocked),
            check(F.col("circuit_breaker_open") > 0, "circuit_breakers", "info", F.col("circuit_breaker_open"), None),
        )
    )
    worst = (
        F.when(F.exists("checks", lambda c: c.check_status == "critical"), "critical")
        .when(F.exists("checks", lambda c: c.check_status == "warning"), "warning")
        .otherwise("healthy")
    )
    return (
        stats.withColumn("checks", checks)
        .withColumn("status", worst)
        .select("status", F.explode_outer("checks").alias("c"))
        .select(
            "status", F.coalesce("c.check_name", F.lit("none")).alias("check_name"), "c.check_status", "c.current", "c.threshold"
        )
    )


def proxy_usage(proxies, as_of, days: int = 7) -> DataFrame:
    since = at(as_of) - F.make_dt_interval(days=F.lit(days))
    return (
        proxies.where(F.col("active") & (F.col("last_used_at") >= since))
        .groupBy(F.to_date("last_used_at").alias("usage_date"))
        .agg(
            F.count(F.lit(1)).alias("proxies_used"),
            avg_if("success_rate").alias("avg_success_rate"),
            F.sum("total_requests").alias("total_requests"),
        )
    )


def proxy_report(top: DataFrame, problems: DataFrame) -> DataFrame:
    """Sizes of the best and the worst list and a score from 0 to 100."""
    both = F.col("top_count") + F.col("performance_issues")
    return (
        bundle(
            top.agg(F.count(F.lit(1)).alias("top_count")), problems.agg(F.count(F.lit(1)).alias("performance_issues"))
        )
        .withColumn("total_active", both)
        .withColumn("health_score", F.round(F.col("top_count") / F.greatest(both, F.lit(1)) * 100, 4))
    )


def session_stats(sessions, as_of) -> DataFrame:
    return live(sessions).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        count_if(F.col("active")).alias("active_sessions"),
        count_if(F.col("validation_status") == "valid").alias("valid_sessions"),
        count_if(F.col("expires_at") < at(as_of)).alias("expired_sessions"),
        F.countDistinct("domain").alias("unique_domains"),
        avg_if("usage_count").alias("avg_usage_count"),
        F.max("last_used_at").alias("last_session_used"),
        count_if(F.col("created_at") >= at(as_of) - F.expr("INTERVAL '24' HOUR")).alias("created_today"),
    )


def contacts_by_country(contacts, as_of) -> DataFrame:
    since = F.to_date(at(as_of)).cast("timestamp_ntz") - F.expr("INTERVAL '7' DAY")
    return (
        live(contacts)
        .where(F.col("country").isNotNull())
        .groupBy("country", "theme")
        .agg(
            F.count(F.lit(1)).alias("total_contacts"),
            count_if(F.col("verified")).alias("verified_contacts"),
            count_if(F.col("created_at") >= since).alias("recent_contacts"),
            F.max("created_at").alias("last_contact_date"),
        )
    )


def jobs_stats(queue, as_of, days: int = 90) -> DataFrame:
    since = F.to_date(at(as_of)).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return (
        live(queue)
        .where(F.col("created_at") >= since)
        .groupBy("theme", "country_filter", F.to_date("created_at").alias("job_date"))
        .agg(
            F.count(F.lit(1)).alias("total_jobs"),
            count_if(status_is("done")).alias("completed_jobs"),
            count_if(status_is("failed")).alias("failed_jobs"),
            avg_if("contacts_extracted", F.col("contacts_extracted") > 0).alias("avg_contacts_per_job"),
            F.sum("contacts_extracted").alias("total_contacts_extracted"),
        )
    )


def business_metrics(queue, contacts, proxies, as_of) -> DataFrame:
    """Eight (metric, value) rows from one pass over each table."""
    row = bundle(
        queue.agg(
            F.count(F.lit(1)).alias("Jobs Total"),
            count_if(status_is("pending")).alias("Jobs Pending"),
            count_if(status_is("done") & on_day("updated_at", as_of)).alias("Jobs Done Today"),
            count_if(status_is("failed") & on_day("updated_at", as_of)).alias("Jobs Failed Today"),
        ),
        contacts.agg(
            count_if(F.col("deleted_at").isNull()).alias("Contacts Total"),
            count_if(on_day("created_at", as_of)).alias("Contacts Today"),
            F.countDistinct("country").alias("Countries Covered"),
        ),
        proxies.agg(count_if(F.col("active")).alias("Proxies Active")),
    )
    return row.unpivot([], row.columns, "metric", "value").withColumn("value", F.col("value").cast("string"))


def job_performance(queue) -> DataFrame:
    done = F.sum(F.when(status_is("done"), 1).otherwise(0))
    return queue.where(F.col("updated_at").isNotNull()).agg(
        F.round(F.avg(seconds_between(F.col("updated_at"), F.col("created_at"))), 4).alias("avg_job_duration"),
        avg_if("contacts_extracted", F.col("contacts_extracted") > 0).alias("avg_contacts_per_job"),
        F.round(F.try_divide(done * F.lit(100.0), F.count(F.lit(1))), 4).alias("success_rate"),
    )


def proxy_hourly(results: DataFrame) -> DataFrame:
    """Request outcomes per proxy, day and hour."""
    return results.groupBy("proxy_id", F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(*hourly_aggregates())


def hourly_aggregates() -> list[Column]:
    code, text = F.col("status_code"), F.lower("message")
    return [
        F.count(F.lit(1)).alias("request_count"),
        count_if(F.col("success")).alias("success_count"),
        count_if(~F.col("success")).alias("fail_count"),
        count_if(text.contains("timeout")).alias("timeout_count"),
        F.coalesce(F.sum("response_time_ms"), F.lit(0)).alias("total_response_ms"),
        F.min("response_time_ms").alias("min_response_ms"),
        F.max("response_time_ms").alias("max_response_ms"),
        avg_if("response_time_ms").alias("avg_response_ms"),
        count_if((code >= 400) & (code < 500)).alias("http_4xx_count"),
        count_if((code >= 500) & (code < 600)).alias("http_5xx_count"),
        count_if(code == 429).alias("rate_limited_count"),
        count_if(text.contains("captcha")).alias("captcha_count"),
        count_if(code == 403).alias("blocked_count"),
    ]


def error_summary(events: DataFrame, category: Column) -> DataFrame:
    return (
        events.withColumn("category", category)
        .groupBy("category", F.to_date("ts").alias("day"), "proxy_id")
        .agg(F.count(F.lit(1)).alias("errors"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    )


def log_summary(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level", "component", F.date_trunc("hour", F.col("log_ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("entries"),
        count_if(~F.coalesce("resolved", F.lit(False)) & (F.col("severity") >= 2)).alias("open_severe"),
    )


def unresolved_logs(logs: DataFrame, severity: int = 2) -> DataFrame:
    """Open entries from a severity on, worst and newest first."""
    return logs.where(~F.coalesce("resolved", F.lit(False)) & (F.col("severity") >= severity)).orderBy(
        F.desc("severity"), F.desc("log_ts"), F.desc("id")
    )


def heartbeat(beats: DataFrame, workers: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """State of each worker by the age of its last sign of life."""
    last = beats.where(F.col("ts") <= at(as_of)).groupBy("worker").agg(F.max("ts").alias("last_beat"))
    age = seconds_between(at(as_of), F.col("last_beat"))
    state = F.when(age.isNull(), "NONE").when(age < minutes * 60, "ACTIVE").otherwise("STALE")
    return workers.join(last, "worker", "left").select("worker", "last_beat", F.round(age, 3).alias("age_seconds"), state.alias("state"))


def js_quota(visits: DataFrame, limit: int = 1000) -> DataFrame:
    """Browser-rendered pages per day against the daily limit."""
    used = F.count(F.lit(1))
    return visits.where("use_js").groupBy(F.to_date("ts").alias("day")).agg(
        used.alias("pages_used"),
        F.greatest(F.lit(limit) - used, F.lit(0)).alias("pages_left"),
        (used >= limit).alias("exhausted"),
    )


def job_runs_rollup(runs: DataFrame) -> DataFrame:
    """Totals per job over its runs."""
    took = seconds_between(F.col("finished_at"), F.col("started_at"))
    return runs.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.sum(took), 3).alias("total_seconds"),
        F.round(F.avg(took), 4).alias("avg_seconds"),
        F.sum("pages").alias("pages"),
        F.sum("contacts").alias("contacts"),
        F.sum("errors").alias("errors"),
        F.round(F.avg(F.when(status_is("failed"), 1.0).otherwise(0.0)), 6).alias("failure_share"),
        F.max("started_at").alias("last_started_at"),
    )


def count_contacts(queue: DataFrame, contacts: DataFrame) -> DataFrame:
    """Stored contacts per job; zero for jobs without any."""
    n = contacts.where(F.col("query_id").isNotNull()).groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return queue.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("contacts_count"))


def item_outcomes(classified: DataFrame) -> DataFrame:
    """Counts per spider of items with an ``outcome`` of saved, duplicate or invalid."""
    saved = count_if(F.col("outcome") == "saved")
    return classified.groupBy("spider").agg(
        F.count(F.lit(1)).alias("items_processed"),
        saved.alias("items_saved"),
        count_if(F.col("outcome") == "duplicate").alias("items_duplicates"),
        count_if(F.col("outcome") == "invalid").alias("items_invalid"),
        F.round(saved / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 4).alias("success_rate"),
    )


def table_inventory(spark: SparkSession, expected: list[str]) -> DataFrame:
    """Expected tables with their rows, as the session's catalog knows them; ``rows`` is null for one that is missing."""
    known = {t.name for t in spark.catalog.listTables()}
    parts = [
        spark.table(name).agg(F.count(F.lit(1)).alias("rows")) if name in known else spark.range(1).select(F.lit(None).cast("bigint").alias("rows"))
        for name in expected
    ]
    named = [part.select(F.lit(name).alias("name"), F.lit(name in known).alias("present"), "rows") for name, part in zip(expected, parts)]
    return functools.reduce(DataFrame.unionByName, named)


def missing_tables(actual: DataFrame, expected: list[str]) -> DataFrame:
    """Expected table names that the catalog does not hold; ``actual`` has a column ``name``."""
    spark = actual.sparkSession
    wanted = spark.createDataFrame([(n,) for n in expected], "name string")
    return wanted.join(actual.select(F.lower("name").alias("name")), "name", "left_anti").orderBy("name")
