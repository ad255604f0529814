"""Reports, filters and top-k queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlops.catalog.registry import query
from crawlops.fixtures import AS_OF, JOBS_AS_OF
from crawlops.functions.lang import keywords_form
from crawlops.functions.text import error_category
from crawlops.operators import filters, jobs, merge, proxies, quality, reports
from crawlops.session import at, scratch

JT = f"TIMESTAMP '{JOBS_AS_OF}'"
NT = f"TIMESTAMP '{AS_OF}'"
JD = f"DATE '{JOBS_AS_OF[:10]}'"
ND = f"DATE '{AS_OF[:10]}'"


def seen_store(t):
    """URL store made of the visits."""
    return t.seen_urls.select(
        "visit_id", "url", "job_id", "processing_status", "skip_reason", F.col("visited_at").alias("first_seen_at"),
        F.col("visited_at").alias("last_seen_at"),
    )


QUEUE_NUMBERS = f"""SELECT count(*) FILTER (WHERE status = 'pending') AS p, count(*) FILTER (WHERE status = 'in_progress') AS r,
  count(*) FILTER (WHERE status = 'done' AND updated_at::DATE = {JD}) AS d,
  count(*) FILTER (WHERE status = 'failed' AND updated_at::DATE = {JD}) AS f FROM queue """
# the queue projection has its own reference day, so the counts of "today" use it




@query("ops_overview_v1", f"""
WITH q AS ({QUEUE_NUMBERS}),
c AS (SELECT count(*) FILTER (WHERE created_at::DATE = {ND}) AS t, count(*) FILTER (WHERE verified) AS v, count(DISTINCT country) AS n FROM contacts ),
x AS (SELECT count(*) FILTER (WHERE active) AS a, round(avg(response_time_ms::DOUBLE) FILTER (WHERE active AND response_time_ms > 0), 6) AS ms,
  round(avg(success_rate) FILTER (WHERE active), 6) AS sr FROM proxies ),
s AS (SELECT count(*) FILTER (WHERE active) AS a, count(*) FILTER (WHERE validation_status = 'valid') AS v FROM sessions )
SELECT q.p AS pending_jobs, q.r AS running_jobs, q.d AS completed_today, q.f AS failed_today, c.t AS contacts_today,
  c.v AS verified_contacts, c.n AS countries_covered, x.a AS active_proxies, x.ms AS avg_proxy_response_time,
  x.sr AS avg_proxy_success_rate, s.a AS active_sessions, s.v AS valid_sessions FROM q, c, x, s""")
def _(t):
    return reports.overview_v1(_shift(t), t.contacts, t.proxies, t.sessions, AS_OF)


def _shift(t):
    """Job days relative to their own reference day, moved onto the common one."""
    days = F.datediff(F.lit(AS_OF[:10]).cast("date"), F.lit(JOBS_AS_OF[:10]).cast("date"))
    return t.queue.withColumn("updated_at", F.col("updated_at") + F.make_dt_interval(days=days))


@query("ops_overview_v2", f"""
WITH q AS ({QUEUE_NUMBERS}),
c AS (SELECT count(*) FILTER (WHERE created_at::DATE = {ND}) AS t, count(*) FILTER (WHERE verified) AS v, count(DISTINCT country) AS n FROM contacts ),
x AS (SELECT count(*) FILTER (WHERE active AND (cooldown_until IS NULL OR cooldown_until < {NT})) AS a,
  round(avg(average_latency_ms) FILTER (WHERE active AND average_latency_ms > 0), 6) AS ms,
  round(avg(success_rate) FILTER (WHERE active), 6) AS sr, count(*) FILTER (WHERE circuit_breaker_status = 'open') AS o FROM proxies ),
s AS (SELECT count(*) FILTER (WHERE active) AS a, count(*) FILTER (WHERE validation_status = 'valid') AS v FROM sessions ),
u AS (SELECT count(*) FILTER (WHERE visited_at::DATE = {ND}) AS n, count(*) FILTER (WHERE processing_status = 'skipped' AND skip_reason = 'duplicate') AS d FROM seen_urls )
SELECT q.p AS pending_jobs, q.r AS running_jobs, q.d AS completed_today, q.f AS failed_today, c.t AS contacts_today,
  c.v AS verified_contacts, c.n AS countries_covered, x.a AS active_proxies, x.ms AS avg_proxy_response_time,
  x.sr AS avg_proxy_success_rate, x.o AS circuit_breaker_open, s.a AS active_sessions, s.v AS valid_sessions,
  u.n AS urls_seen_today, u.d AS duplicates_skipped FROM q, c, x, s, u""")
def _(t):
    return reports.overview_v2(_shift(t), t.contacts, t.proxies, t.sessions, seen_store(t), AS_OF)


@query("scheduler_stats", f"""
WITH q AS ({QUEUE_NUMBERS} WHERE deleted_at IS NULL)
SELECT q.p AS pending_jobs, q.r AS active_jobs, q.d AS completed_today, q.f AS failed_today,
  (SELECT count(*) FROM contacts WHERE created_at::DATE = {ND} AND deleted_at IS NULL) AS contacts_today,
  0 AS running_jobs, 'running' AS scheduler_status, 3 AS max_concurrent_jobs FROM q""")
def _(t):
    return reports.scheduler_stats(_shift(t), t.contacts, AS_OF)


@query("dashboard_tiles", f"""
WITH q AS ({QUEUE_NUMBERS} WHERE deleted_at IS NULL)
SELECT q.p AS pending_jobs, q.r AS active_jobs, q.d AS completed_jobs,
  (SELECT count(*) FROM contacts WHERE created_at::DATE = {ND} AND deleted_at IS NULL) AS total_contacts,
  (SELECT count(*) FROM proxies WHERE active) AS active_proxies FROM q""")
def _(t):
    return reports.tiles(_shift(t), t.contacts, t.proxies, AS_OF)


@query("metric_bundle", """
SELECT (SELECT count(*) FROM queue ) AS jobs, (SELECT count(*) FROM contacts ) AS contacts, (SELECT max(ts) FROM events) AS last_event""")
def _(t):
    return reports.bundle(
        t.queue.agg(F.count(F.lit(1)).alias("jobs")), t.contacts.agg(F.count(F.lit(1)).alias("contacts")),
        t.events.agg(F.max("ts").alias("last_event")),
    )


@query("contact_stats", f"""
SELECT count(*) AS total_contacts, count(*) FILTER (WHERE created_at::DATE = {ND} - 1) AS today_contacts,
  count(*) FILTER (WHERE verified) AS verified_contacts, count(DISTINCT country) AS unique_countries
FROM contacts WHERE deleted_at IS NULL""")
def _(t):
    return reports.contact_stats(t.contacts, "2024-01-30 12:00:00")


@query("totals_stats", """
SELECT (SELECT count(*) FROM queue WHERE deleted_at IS NULL) AS total_jobs,
  (SELECT max(created_at) FROM queue WHERE deleted_at IS NULL) AS last_job_created,
  (SELECT count(*) FROM contacts WHERE deleted_at IS NULL) AS total_contacts, (SELECT count(*) FROM proxies ) AS total_proxies""")
def _(t):
    return reports.totals(t.queue, t.contacts, t.proxies)


@query("proxy_stats_basic", """
SELECT count(*) AS total_proxies, count(*) FILTER (WHERE active) AS active_proxies,
  count(*) FILTER (WHERE consecutive_failures >= 5) AS blocked_proxies,
  round(avg(success_rate) FILTER (WHERE active), 6) AS avg_success_rate,
  round(avg(response_time_ms::DOUBLE) FILTER (WHERE active AND response_time_ms > 0), 6) AS avg_response_time FROM proxies """)
def _(t):
    return reports.proxy_stats_basic(t.proxies)


FULL_STATS = f"""SELECT count(*) AS total_proxies, count(*) FILTER (WHERE active) AS active_proxies,
  count(*) FILTER (WHERE active AND (cooldown_until IS NULL OR cooldown_until < {NT})) AS usable_proxies,
  count(*) FILTER (WHERE consecutive_failures >= 3) AS blocked_proxies,
  count(*) FILTER (WHERE circuit_breaker_status = 'open') AS circuit_breaker_open,
  count(*) FILTER (WHERE circuit_breaker_status = 'half_open') AS circuit_breaker_half_open,
  round(avg(success_rate) FILTER (WHERE active), 3) AS avg_success_rate,
  round(avg(average_latency_ms) FILTER (WHERE active AND average_latency_ms > 0), 1) AS avg_response_time,
  count(*) FILTER (WHERE last_used_at >= {NT} - INTERVAL '1' HOUR) AS recently_used,
  count(*) FILTER (WHERE last_used_at >= {NT} - INTERVAL '24' HOUR) AS used_today,
  count(DISTINCT country_code) FILTER (WHERE active) AS countries_available,
  count(DISTINCT provider) FILTER (WHERE active) AS providers_available,
  max(last_used_at) AS last_proxy_used, CAST(sum(total_requests) FILTER (WHERE active) AS BIGINT) AS total_requests_today FROM proxies """


@query("proxy_stats_full", FULL_STATS)
def _(t):
    return reports.proxy_stats_full(t.proxies, AS_OF)


@query("proxy_health", f"""
WITH s AS ({FULL_STATS}),
c AS (SELECT 'usable_proxies' AS check_name, 'warning' AS check_status, usable_proxies::DOUBLE AS current, 3::DOUBLE AS threshold FROM s WHERE usable_proxies < 3
  UNION ALL SELECT 'success_rate', 'warning', avg_success_rate, 0.7::DOUBLE FROM s WHERE avg_success_rate <> 0 AND avg_success_rate < 0.7
  UNION ALL SELECT 'response_time', 'warning', avg_response_time, 5000::DOUBLE FROM s WHERE avg_response_time > 5000
  UNION ALL SELECT 'blocked_ratio', 'critical', blocked_proxies / total_proxies, 0.5::DOUBLE FROM s WHERE blocked_proxies / total_proxies > 0.5
  UNION ALL SELECT 'circuit_breakers', 'info', circuit_breaker_open::DOUBLE, NULL FROM s WHERE circuit_breaker_open > 0)
SELECT CASE WHEN (SELECT count(*) FROM c WHERE check_status = 'critical') > 0 THEN 'critical'
  WHEN (SELECT count(*) FROM c WHERE check_status = 'warning') > 0 THEN 'warning' ELSE 'healthy' END AS status,
  coalesce(c.check_name, 'none') AS check_name, c.check_status, c.current, c.threshold FROM s LEFT JOIN c ON TRUE""")
def _(t):
    return reports.proxy_health(reports.proxy_stats_full(t.proxies, AS_OF))


@query("proxy_usage_daily", f"""
SELECT last_used_at::DATE AS usage_date, count(*) AS proxies_used, round(avg(success_rate), 6) AS avg_success_rate,
  CAST(sum(total_requests) AS BIGINT) AS total_requests FROM proxies
WHERE active AND last_used_at >= {NT} - INTERVAL '7' DAY GROUP BY 1""")
def _(t):
    return reports.proxy_usage(t.proxies, AS_OF)


TOP = """SELECT * FROM proxies WHERE active AND success_rate IS NOT NULL
  ORDER BY success_rate DESC, average_latency_ms ASC NULLS LAST, id LIMIT 10"""
PROBLEMS = """SELECT * FROM proxies WHERE active AND (consecutive_failures >= 3 OR circuit_breaker_status <> 'closed')
  ORDER BY consecutive_failures DESC NULLS FIRST, last_failure_at DESC NULLS FIRST, id LIMIT 10"""


@query("proxy_top", f"SELECT id, host, port, success_rate, average_latency_ms, total_requests, last_used_at, country_code, provider FROM ({TOP})")
def _(t):
    return proxies.top_proxies(t.proxies).select(
        "id", "host", "port", "success_rate", "average_latency_ms", "total_requests", "last_used_at", "country_code", "provider"
    )


@query("proxy_problems", f"SELECT id, host, port, success_rate, consecutive_failures, circuit_breaker_status, last_failure_at, country_code FROM ({PROBLEMS})")
def _(t):
    return proxies.problem_proxies(t.proxies).select(
        "id", "host", "port", "success_rate", "consecutive_failures", "circuit_breaker_status", "last_failure_at", "country_code"
    )


@query("proxy_report_summary", f"""
WITH a AS (SELECT (SELECT count(*) FROM ({TOP})) AS t, (SELECT count(*) FROM ({PROBLEMS})) AS p)
SELECT t AS top_count, p AS performance_issues, t + p AS total_active, round(t / greatest(1, t + p) * 100, 4) AS health_score FROM a""")
def _(t):
    return reports.proxy_report(proxies.top_proxies(t.proxies), proxies.problem_proxies(t.proxies))


@query("session_stats", f"""
SELECT count(*) AS total_sessions, count(*) FILTER (WHERE active) AS active_sessions,
  count(*) FILTER (WHERE validation_status = 'valid') AS valid_sessions, count(*) FILTER (WHERE expires_at < {NT}) AS expired_sessions,
  count(DISTINCT domain) AS unique_domains, round(avg(usage_count::DOUBLE), 6) AS avg_usage_count, max(last_used_at) AS last_session_used,
  count(*) FILTER (WHERE created_at >= {NT} - INTERVAL '24' HOUR) AS created_today FROM sessions WHERE deleted_at IS NULL""")
def _(t):
    return reports.session_stats(t.sessions, AS_OF)


BY_COUNTRY = f"""SELECT country, theme, count(*) AS total_contacts, count(*) FILTER (WHERE verified) AS verified_contacts,
  count(*) FILTER (WHERE created_at >= {ND} - INTERVAL '7' DAY) AS recent_contacts, max(created_at) AS last_contact_date
FROM contacts WHERE deleted_at IS NULL AND country IS NOT NULL GROUP BY country, theme"""


@query("contacts_by_country_theme", BY_COUNTRY)
def contacts_by_country_theme(t):
    return reports.contacts_by_country(t.contacts, AS_OF)


@query("jobs_by_theme_day", f"""
SELECT theme, country_filter, created_at::DATE AS job_date, count(*) AS total_jobs, count(*) FILTER (WHERE status = 'done') AS completed_jobs,
  count(*) FILTER (WHERE status = 'failed') AS failed_jobs,
  round(avg(contacts_extracted::DOUBLE) FILTER (WHERE contacts_extracted > 0), 6) AS avg_contacts_per_job,
  CAST(sum(contacts_extracted) AS BIGINT) AS total_contacts_extracted
FROM queue WHERE deleted_at IS NULL AND created_at >= {JD} - INTERVAL '90' DAY GROUP BY 1, 2, 3""")
def _(t):
    return reports.jobs_stats(t.queue, JOBS_AS_OF)


BUSINESS = f"""
WITH q AS ({QUEUE_NUMBERS})
SELECT 'Jobs Total' AS metric, CAST(count(*) AS VARCHAR) AS value FROM queue
UNION ALL SELECT 'Jobs Pending', CAST(p AS VARCHAR) FROM q UNION ALL SELECT 'Jobs Done Today', CAST(d AS VARCHAR) FROM q
UNION ALL SELECT 'Jobs Failed Today', CAST(f AS VARCHAR) FROM q
UNION ALL SELECT 'Contacts Total', CAST(count(*) AS VARCHAR) FROM contacts WHERE deleted_at IS NULL
UNION ALL SELECT 'Contacts Today', CAST(count(*) AS VARCHAR) FROM contacts WHERE created_at::DATE = {ND}
UNION ALL SELECT 'Proxies Active', CAST(count(*) AS VARCHAR) FROM proxies WHERE active
UNION ALL SELECT 'Countries Covered', CAST(count(DISTINCT country) AS VARCHAR) FROM contacts """


@query("business_metrics", BUSINESS)
def _(t):
    return reports.business_metrics(_shift(t), t.contacts, t.proxies, AS_OF)


@query("union_metrics", """
SELECT 'events' AS metric, count(*) AS value FROM events UNION ALL SELECT 'pages', count(*) FROM pages
UNION ALL SELECT 'documents', count(*) FROM documents""")
def _(t):
    rows = [getattr(t, n).agg(F.count(F.lit(1)).alias("value")).select(F.lit(n).alias("metric"), "value") for n in ("events", "pages", "documents")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("job_performance", """
SELECT round(avg((epoch_us(updated_at) - epoch_us(created_at)) / 1e6), 4) AS avg_job_duration,
  round(avg(contacts_extracted::DOUBLE) FILTER (WHERE contacts_extracted > 0), 6) AS avg_contacts_per_job,
  round(count(*) FILTER (WHERE status = 'done') * 100.0::DOUBLE / count(*), 4) AS success_rate FROM queue WHERE updated_at IS NOT NULL""")
def _(t):
    return reports.job_performance(t.queue)


HOURLY = """count(*) AS request_count, count(*) FILTER (WHERE success) AS success_count, count(*) FILTER (WHERE NOT success) AS fail_count,
  count(*) FILTER (WHERE lower(message) LIKE '%timeout%') AS timeout_count, CAST(coalesce(sum(response_time_ms), 0) AS BIGINT) AS total_response_ms,
  min(response_time_ms) AS min_response_ms, max(response_time_ms) AS max_response_ms, round(avg(response_time_ms::DOUBLE), 6) AS avg_response_ms,
  count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS http_4xx_count, count(*) FILTER (WHERE status_code BETWEEN 500 AND 599) AS http_5xx_count,
  count(*) FILTER (WHERE status_code = 429) AS rate_limited_count, count(*) FILTER (WHERE lower(message) LIKE '%captcha%') AS captcha_count,
  count(*) FILTER (WHERE status_code = 403) AS blocked_count"""


@query("proxy_hourly", f"""
SELECT proxy_id, ts::DATE AS date, CAST(hour(ts) AS INTEGER) AS hour, {HOURLY} FROM proxy_results GROUP BY 1, 2, 3""")
def _(t):
    return reports.proxy_hourly(t.proxy_results)


CATEGORY = """CASE WHEN status_code BETWEEN 500 AND 599 THEN 'http_5xx' WHEN status_code BETWEEN 400 AND 499 THEN 'http_4xx'
  WHEN lower(message) LIKE '%timeout%' THEN 'timeout' WHEN lower(message) LIKE '%proxy%' THEN 'proxy' WHEN lower(message) LIKE '%ssl%' THEN 'network'
  WHEN lower(message) LIKE '%connection refused%' THEN 'network' WHEN lower(message) LIKE '%dns%' THEN 'network'
  WHEN lower(message) LIKE '%captcha%' THEN 'anti_bot' ELSE 'unknown' END"""


@query("error_summary", f"""
SELECT {CATEGORY} AS category, ts::DATE AS day, proxy_id, count(*) AS errors, min(ts) AS first_at, max(ts) AS last_at
FROM proxy_results WHERE NOT success GROUP BY 1, 2, 3""")
def _(t):
    return reports.error_summary(t.proxy_results.where(~F.col("success")), error_category("status_code", "message"))


@query("error_category", f"SELECT event_id, {CATEGORY} AS category FROM proxy_results ")
def _(t):
    return t.proxy_results.select("event_id", error_category("status_code", "message").alias("category"))


@query("src_error_rules", f"""
SELECT id, CASE WHEN lower(last_error) LIKE '%timeout%' THEN 'timeout' WHEN lower(last_error) LIKE '%proxy%' THEN 'proxy'
  WHEN lower(last_error) LIKE '%connection refused%' THEN 'network' WHEN lower(last_error) LIKE '%dns%' THEN 'network'
  WHEN lower(last_error) LIKE '%captcha%' THEN 'anti_bot' ELSE 'unknown' END AS category FROM queue """)
def _(t):
    return t.queue.select("id", error_category(F.lit(None).cast("int"), "last_error").alias("category"))


@query("log_summary", """
SELECT level, component, date_trunc('hour', log_ts) AS hour, count(*) AS entries,
  count(*) FILTER (WHERE NOT resolved AND severity >= 2) AS open_severe FROM system_logs GROUP BY 1, 2, 3""")
def _(t):
    return reports.log_summary(t.system_logs)


@query("log_unresolved", "SELECT id, log_ts, level, component, job_id, severity FROM system_logs WHERE NOT resolved AND severity >= 2")
def _(t):
    return reports.unresolved_logs(t.system_logs).select("id", "log_ts", "level", "component", "job_id", "severity")


@query("heartbeat_freshness", """
WITH w AS (SELECT c_custkey AS worker FROM customer), b AS (SELECT user_id AS worker, max(ts) AS last_beat FROM events
  WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1)
SELECT w.worker, b.last_beat, round((epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(b.last_beat)) / 1e6, 3) AS age_seconds,
  CASE WHEN b.last_beat IS NULL THEN 'NONE' WHEN epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(b.last_beat) < 300000000 THEN 'ACTIVE' ELSE 'STALE' END AS state
FROM w LEFT JOIN b ON w.worker = b.worker""")
def _(t):
    beats = t.events.select(F.col("user_id").alias("worker"), "ts")
    return reports.heartbeat(beats, t.customer.select(F.col("c_custkey").alias("worker")), "2024-01-20 12:00:00")


@query("js_quota", """
SELECT ts::DATE AS day, count(*) AS pages_used, greatest(60 - count(*), 0) AS pages_left, count(*) >= 60 AS exhausted
FROM events WHERE event_type = 'view' GROUP BY 1""")
def _(t):
    return reports.js_quota(t.events.select("ts", (F.col("event_type") == "view").alias("use_js")), 60)


@query("job_runs_rollup", """
SELECT job_id, count(*) AS runs, round(sum((epoch_us(finished_at) - epoch_us(started_at)) / 1e6), 3) AS total_seconds,
  round(avg((epoch_us(finished_at) - epoch_us(started_at)) / 1e6), 4) AS avg_seconds, CAST(sum(pages) AS BIGINT) AS pages,
  CAST(sum(contacts) AS BIGINT) AS contacts, CAST(sum(errors) AS BIGINT) AS errors,
  round(avg(CASE WHEN status = 'failed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS failure_share, max(started_at) AS last_started_at
FROM job_runs GROUP BY 1""")
def _(t):
    return reports.job_runs_rollup(t.job_runs)


@query("job_run_numbers", """
SELECT id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY started_at, id) AS run_number,
  (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS seconds FROM job_runs """)
def _(t):
    return jobs.number_runs(t.job_runs).select("id", "job_id", "run_number", "seconds")


@query("contacts_per_job", """
SELECT q.id, coalesce(c.n, 0) AS contacts_count FROM queue q LEFT JOIN (SELECT query_id, count(*) AS n FROM contacts GROUP BY 1) c ON c.query_id = q.id""")
def _(t):
    return reports.count_contacts(t.queue, t.contacts)


# ------------------------------------------------------------------ filters


@query("live_rows", "SELECT id, name, email, country, created_at FROM contacts WHERE deleted_at IS NULL")
def _(t):
    return filters.live(t.contacts).select("id", "name", "email", "country", "created_at")


@query("src_tables", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(t):
    from crawlops.schemas import EVENTS
    from crawlops.sources.readers import read_table

    return read_table(t.spark, f"{t.sf_dir}/events.parquet", EVENTS).select("event_id", "ts", "user_id", "event_type", "value")


SEARCH = """SELECT id, name, email, org, phone, country, coalesce(verified, FALSE) AS verified, created_at,
  CASE WHEN verified THEN '✅' ELSE '⏳' END AS verified_icon FROM contacts
WHERE deleted_at IS NULL AND (name ILIKE '%{0}%' OR email ILIKE '%{0}%' OR org ILIKE '%{0}%') {1} ORDER BY created_at DESC, id DESC LIMIT 500"""


@query("contact_search", SEARCH.format("GMAIL", "AND country = 'NATION_3'"))
def _(t):
    return filters.search_contacts(t.contacts, "GMAIL", "NATION_3")


@query("contact_search_any", SEARCH.format("consul", ""))
def _(t):
    return filters.search_contacts(t.contacts, "consul")


@query("contacts_filtered", f"""
SELECT id, name, email, phone, country, created_at FROM contacts WHERE deleted_at IS NULL AND created_at >= {NT} - INTERVAL '30' DAY
  AND email IS NOT NULL AND phone IS NOT NULL AND phone <> '' """)
def _(t):
    since = at(AS_OF) - F.expr("INTERVAL '30' DAY")
    return filters.filter_contacts(t.contacts, None, since, ("email", "phone")).select("id", "name", "email", "phone", "country", "created_at")


@query("contacts_by_mail_domain", """
SELECT id, lower(email) AS email_lc, lower(split_part(email, '@', 2)) AS email_domain FROM contacts
WHERE lower(split_part(email, '@', 2)) IN ('gmail.com', 'proton.me')""")
def _(t):
    return filters.by_mail_domain(t.contacts, ["gmail.com", "Proton.me"]).select("id", "email_lc", "email_domain")


@query("contact_countries", "SELECT DISTINCT country FROM contacts WHERE country IS NOT NULL AND deleted_at IS NULL")
def _(t):
    return filters.country_options(t.contacts)


@query("src_countries", "SELECT DISTINCT n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    from crawlops.sources.readers import load_countries

    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy().agg(F.collect_set("n_name").alias("countries"))
    path = scratch(t.spark, "countries")
    named.coalesce(1).write.json(path)
    return load_countries(t.spark, path)


@query("jobs_recent", """
SELECT id, status, CASE status WHEN 'done' THEN '✅' WHEN 'failed' THEN '❌' WHEN 'in_progress' THEN '⚡' ELSE '⏳' END AS status_icon,
  substring(url, 1, 50) || '...' AS url_short, CASE id % 2 WHEN 0 THEN '—' ELSE theme || ', b, c (+1)' END AS keywords_display,
  match_mode, created_at, updated_at FROM queue WHERE deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 20""")
def _(t):
    words = F.when(F.col("id") % 2 == 1, F.concat("theme", F.lit(", b; c,d"))).otherwise("")
    return filters.recent_jobs(t.queue, keywords_form(words))


@query("proxies_masked", """
SELECT id, active, CASE WHEN active THEN '🟢' ELSE '🔴' END AS status_icon, created_at,
  scheme || '://' || CASE WHEN username IS NOT NULL THEN username || ':***@' ELSE '' END || host || ':' || CAST(port AS VARCHAR) AS proxy_url FROM proxies """)
def _(t):
    return proxies.mask_proxies(t.proxies)


ELIGIBLE = f"""active AND (cooldown_until IS NULL OR cooldown_until < {NT})
  AND (circuit_breaker_status <> 'open' OR circuit_breaker_next_attempt < {NT})"""
SIMPLE = f"active AND (cooldown_until IS NULL OR cooldown_until < {NT}) AND coalesce(consecutive_failures, 0) < 5"


@query("proxy_eligible", f"SELECT id, host FROM proxies WHERE {ELIGIBLE}")
def _(t):
    return proxies.eligible_proxies(t.proxies, AS_OF).select("id", "host")


@query("proxy_eligible_simple", f"SELECT id, host FROM proxies WHERE {SIMPLE}")
def _(t):
    return proxies.eligible_simple(t.proxies, AS_OF).select("id", "host")


@query("session_available", f"""
SELECT id, domain, CASE WHEN validation_status = 'valid' THEN 1 ELSE 3 END AS status_rank, last_used_at FROM sessions
WHERE active AND deleted_at IS NULL AND (expires_at IS NULL OR expires_at > {NT})""")
def _(t):
    return filters.available_sessions(t.sessions, AS_OF).select("id", "domain", "status_rank", "last_used_at")


@query("session_usable", f"""
WITH r AS (SELECT id, domain, CASE WHEN NOT active THEN 'inactive' WHEN type <> 'storage_state' THEN 'wrong_type' WHEN expires_at < {NT} THEN 'expired'
  WHEN validation_status = 'invalid' THEN 'invalid' WHEN file_path IS NULL THEN 'no_path' END AS reason FROM sessions )
SELECT id, domain, reason IS NULL AS usable, reason FROM r""")
def _(t):
    return filters.session_verdict(t.sessions, AS_OF)


DUE = f"status = 'pending' AND deleted_at IS NULL AND (next_retry_at IS NULL OR next_retry_at <= {JT})"


@query("job_due", f"SELECT id, priority, next_retry_at FROM queue WHERE {DUE}")
def _(t):
    return filters.due_jobs(t.queue, JOBS_AS_OF).select("id", "priority", "next_retry_at")


@query("job_claim", f"SELECT id, url, priority, retry_count, created_at FROM queue WHERE {DUE} ORDER BY priority, retry_count, created_at, id LIMIT 8")
def _(t):
    return filters.claim(t.queue, JOBS_AS_OF, 10, 2).select("id", "url", "priority", "retry_count", "created_at")


FULL_ORDER = """CASE circuit_breaker_status WHEN 'closed' THEN 1 WHEN 'half_open' THEN 2 ELSE 3 END, priority, coalesce(success_rate, 1.0) DESC,
  coalesce(average_latency_ms, response_time_ms, 1000), coalesce(last_used_at, TIMESTAMP '1970-01-01'), id"""
SIMPLE_ORDER = """priority, coalesce(success_rate, 1.0) DESC, coalesce(response_time_ms, 0), coalesce(last_used_at, TIMESTAMP '1970-01-01'), id"""


@query("proxy_rank", f"SELECT id, row_number() OVER (ORDER BY {FULL_ORDER}) AS rank FROM proxies WHERE {ELIGIBLE}")
def _(t):
    return proxies.rank_proxies(t.proxies, AS_OF).select("id", "rank")


@query("proxy_rank_simple", f"SELECT id, row_number() OVER (ORDER BY {SIMPLE_ORDER}) AS rank FROM proxies WHERE {SIMPLE}")
def _(t):
    return proxies.rank_simple(t.proxies, AS_OF).select("id", "rank")


@query("proxy_rank_doc", """
SELECT id, row_number() OVER (ORDER BY priority, response_time_ms NULLS LAST, success_rate DESC NULLS FIRST, id) AS rank FROM proxies WHERE active""")
def _(t):
    return proxies.rank_doc(t.proxies).select("id", "rank")


@query("topk_country", """
SELECT country, count(*) AS new_contacts FROM contacts WHERE created_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL '24' HOUR
  AND created_at <= TIMESTAMP '2024-01-30 12:00:00' AND country IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return filters.topk_country(t.contacts, "2024-01-30 12:00:00")


TEXT_SEARCH = """
SELECT id, name, org, email FROM contacts WHERE list_has_all(regexp_split_to_array(lower(concat_ws(' ', name, org, email)), '[^\\p{L}\\p{N}@._-]+'), ['consulting', 'nation_3'])"""


@query("text_search", TEXT_SEARCH)
def _(t):
    return filters.text_search(t.contacts, ["consulting", "NATION_3"]).select("id", "name", "org", "email")


# ------------------------------------------------------------------ retention, quality


RETAINED_LOGS = f"SELECT id, log_ts, level FROM system_logs WHERE log_ts >= {NT} - INTERVAL '10' DAY"


@query("retention_logs", RETAINED_LOGS)
def _(t):
    return filters.retain(t.system_logs, "log_ts", 10, AS_OF).select("id", "log_ts", "level")


OLD = f"status IN ('done', 'failed') AND updated_at < {JT} - INTERVAL '30' DAY AND deleted_at IS NULL"


@query("retention_jobs", f"SELECT id, status, CASE WHEN {OLD} THEN {JT} ELSE deleted_at END AS deleted_at FROM queue ")
def _(t):
    return filters.retain_jobs(t.queue, 30, JOBS_AS_OF).select("id", "status", "deleted_at")


@query("retention_jobs_hard", f"SELECT id, status FROM queue WHERE NOT ({OLD})")
def _(t):
    return filters.retain_jobs(t.queue, 30, JOBS_AS_OF, hard=True).select("id", "status")


@query("retention_report", f"""
SELECT 'system_logs' AS table_name, count(*) AS deleted_rows FROM system_logs WHERE log_ts < {NT} - INTERVAL '20' DAY
UNION ALL SELECT 'metrics', count(*) FROM metrics WHERE ts < {NT} - INTERVAL '10' DAY UNION ALL SELECT 'queue', count(*) FROM queue WHERE {OLD}""")
def _(t):
    return filters.retention_report(
        {
            "system_logs": filters.expired_rows(t.system_logs, "log_ts", 20, AS_OF),
            "metrics": filters.expired_rows(t.metrics, "ts", 10, AS_OF),
            "queue": t.queue.where(filters.finished_before(30, JOBS_AS_OF)),
        }
    )


@query("revisit_due", f"""
SELECT visit_id, url, visited_at + INTERVAL '168' HOUR AS next_revisit_after FROM seen_urls WHERE visited_at + INTERVAL '168' HOUR <= TIMESTAMP '2024-01-16 00:00:00'""")
def _(t):
    return filters.revisit_due(seen_store(t), "2024-01-16 00:00:00").select("visit_id", "url", "next_revisit_after")


@query("rerun_due", f"""
SELECT id, last_run_at + min_rerun_hours * INTERVAL '1' HOUR AS rerun_at FROM queue
WHERE deleted_at IS NULL AND status = 'done' AND last_run_at + min_rerun_hours * INTERVAL '1' HOUR <= TIMESTAMP '1996-01-01 00:00:00'""")
def _(t):
    return filters.rerun_due(t.queue, "1996-01-01 00:00:00").select("id", "rerun_at")


@query("dq_domains", """
WITH b AS (SELECT unnest([CASE WHEN NOT status IN ('pending', 'in_progress', 'done', 'failed') THEN 'status' END,
  CASE WHEN NOT match_mode IN ('any', 'multiple') THEN 'match_mode' END, CASE WHEN NOT retry_count <= 3 THEN 'retry_count' END,
  CASE WHEN NOT lang_filter IN ('fr', 'en') THEN 'lang_filter' END]) AS rule FROM queue )
SELECT rule, count(*) AS violations FROM b WHERE rule IS NOT NULL GROUP BY 1""")
def _(t):
    return quality.dq_domain_violations(
        t.queue,
        {
            "status": F.col("status").isin("pending", "in_progress", "done", "failed"),
            "match_mode": F.col("match_mode").isin("any", "multiple"),
            "retry_count": F.col("retry_count") <= 3,
            "lang_filter": F.col("lang_filter").isin("fr", "en"),
        },
    )


@query("dq_unique", "SELECT email, count(*) AS copies FROM contacts WHERE deleted_at IS NULL AND email IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return quality.dq_duplicates(t.contacts, {"email": "email"}, F.col("deleted_at").isNull())


@query("dq_orphans", "SELECT id, query_id FROM contacts WHERE query_id IS NOT NULL AND query_id NOT IN (SELECT id FROM queue WHERE deleted_at IS NULL)")
def _(t):
    return quality.dq_orphans(t.contacts, filters.live(t.queue), "query_id", "id").select("id", "query_id")


@query("schema_evolve", """
SELECT id, email, CAST(0 AS INTEGER) AS merge_count, TRUE AS is_primary, CAST(NULL AS BIGINT) AS duplicate_of FROM contacts """)
def _(t):
    spec = [("email", "string", "none"), ("merge_count", "int", 0), ("is_primary", "boolean", True), ("duplicate_of", "bigint", None)]
    return quality.evolve(t.contacts.select("id", "email"), spec)


@query("contacts_latest", """
SELECT id, email, name, created_at FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, id DESC) AS rn FROM contacts ) WHERE rn = 1""")
def _(t):
    return merge.latest_per_email(t.contacts.select("id", "email", "name", "created_at"))


@query("checkpoint_latest", """
SELECT job_id, phase, id, started_at AS checkpoint_at FROM (SELECT *, row_number() OVER (PARTITION BY job_id, phase ORDER BY started_at DESC, id DESC) AS rn
  FROM job_runs WHERE is_active AND (valid_until IS NULL OR valid_until > TIMESTAMP '1997-01-01')) WHERE rn = 1""")
def _(t):
    points = t.job_runs.select("job_id", "phase", "id", F.col("started_at").alias("checkpoint_at"), "valid_until", "is_active")
    return jobs.resume_points(points, "1997-01-01 00:00:00").select("job_id", "phase", "id", "checkpoint_at")


@query("table_inventory", """
SELECT unnest(['scheduler', 'spider', 'proxies', 'queue']) AS name EXCEPT SELECT DISTINCT component FROM system_logs """)
def _(t):
    """Expected names that never occur among the logged components."""
    actual = t.system_logs.select(F.col("component").alias("name")).distinct()
    return reports.missing_tables(actual, ["scheduler", "spider", "proxies", "queue"])


INVENTORY = ["customer", "orders", "events", "documents", "scraping_jobs", "contacts_archive"]


@query("table_inventory_catalog", f"""
WITH e AS (SELECT unnest({INVENTORY}) AS name), n AS ({" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS rows FROM {name}" for name in INVENTORY[:4])})
SELECT e.name, t.table_name IS NOT NULL AS present, n.rows FROM e LEFT JOIN information_schema.tables t ON t.table_name = e.name LEFT JOIN n ON n.name = e.name""")
def _(t):
    """Which of the expected tables the catalog has; the given ones are made known to it as views first."""
    for name in INVENTORY[:4]:
        t.scan(name).createOrReplaceTempView(name)
    return reports.table_inventory(t.spark, INVENTORY)
