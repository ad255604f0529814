"""Operational tables projected from the given tables.

Every projection is plain SQL that reads the same in Spark and in the SQL oracle.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession


# Tables and projections whose rows carry costly text work, and the setting that deals them out over so many parts.
TEXTS = {"documents", "pages", "conversations", "contact_items", "corpus"}
PARTS = "crawlops.fixtures.parts"

# Reference times of the projected tables.
JOBS_AS_OF = "2001-08-01 12:00:00"
AS_OF = "2024-01-31 00:00:00"

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SQL = {
    "queue": """
SELECT o.o_orderkey AS id,
  concat('https://site', CAST(o.o_custkey % 50 AS STRING), '.acme.org/p', CAST(o.o_orderkey AS STRING)) AS url,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE n.n_name END AS country_filter,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' ELSE NULL END AS lang_filter,
  lower(c.c_mktsegment) AS theme,
  CASE WHEN o.o_orderstatus = 'O' THEN 'pending'
       WHEN o.o_orderstatus = 'P' THEN CASE WHEN o.o_orderkey % 10 = 0 THEN 'paused' ELSE 'in_progress' END
       WHEN o.o_orderkey % 7 = 0 THEN 'failed' ELSE 'done' END AS status,
  CAST(substring(o.o_orderpriority, 1, 1) AS INT) AS priority,
  CAST(o.o_orderkey % 5 AS INT) AS retry_count, 3 AS max_retries,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'Timeout apres 60 minutes' WHEN 1 THEN 'Connection refused' WHEN 2 THEN 'proxy 407'
       WHEN 3 THEN 'Captcha page' WHEN 4 THEN 'DNS lookup' ELSE 'boom' END AS last_error,
  CAST(o.o_orderkey % 11 AS INT) AS contacts_extracted,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'multiple' ELSE 'all' END AS match_mode,
  2 AS min_matches,
  CASE o.o_orderkey % 4 WHEN 0 THEN '["Contact", "the "]' WHEN 1 THEN 'Consulting, tion; le' WHEN 2 THEN 'contact,con'
       ELSE NULL END AS custom_keywords,
  o.o_orderdate AS created_at,
  o.o_orderdate + (o.o_orderkey % 240) * INTERVAL '1' HOUR AS updated_at,
  CASE WHEN o.o_orderkey % 6 = 0 THEN o.o_orderdate + INTERVAL '30' MINUTE END AS next_retry_at,
  CASE WHEN o.o_orderkey % 50 = 0 THEN o.o_orderdate + INTERVAL '10' DAY END AS deleted_at,
  o.o_orderdate + (o.o_orderkey % 240) * INTERVAL '1' HOUR - (o.o_orderkey % 150) * INTERVAL '1' MINUTE AS last_run_at,
  CAST(CASE o.o_orderkey % 3 WHEN 0 THEN 168 WHEN 1 THEN 24 ELSE 1000 END AS INT) AS min_rerun_hours
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "contact_items": """
SELECT o.o_orderkey AS item_id, o.o_orderkey % 2000 AS query_id,
  CASE WHEN o.o_orderkey % 3 = 0 THEN NULL WHEN o.o_orderkey % 3 = 1 THEN c.c_name ELSE concat('  Dr ', c.c_name, '!  ') END AS name,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE concat(n.n_name, ' Consulting') END AS org,
  CASE o.o_orderkey % 23 WHEN 0 THEN 'noreply@acme.org' WHEN 1 THEN 'not-an-email' WHEN 2 THEN NULL
    ELSE concat('Ada.', c.c_mktsegment, '_', CAST(c.c_custkey AS STRING), '@mail', CAST(c.c_custkey % 7 AS STRING), '.acme.org') END AS email,
  CASE WHEN o.o_orderkey % 5 = 0 THEN concat('+33 1 23 45 ', CAST(10 + o.o_orderkey % 90 AS STRING), ' 00') END AS phone,
  CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE n.n_name END AS country,
  CASE WHEN o.o_orderkey % 8 = 0 THEN 'no-scheme' ELSE concat('https://www.acme.org/', CAST(o.o_orderkey AS STRING)) END AS url,
  o.o_orderdate AS seen_at
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "contacts": """
SELECT c.c_custkey AS id, c.c_name AS name, concat(n.n_name, ' Consulting') AS org,
  concat('Ada.', lower(c.c_mktsegment), CAST(c.c_custkey % 400 AS STRING), CASE c.c_custkey % 3 WHEN 0 THEN '@gmail.com' WHEN 1 THEN '@proton.me' ELSE '@acme.org' END) AS email,
  CASE WHEN c.c_custkey % 5 = 0 THEN concat('33 1 ', CAST(c.c_custkey AS STRING)) END AS phone,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE n.n_name END AS country, lower(c.c_mktsegment) AS theme,
  CASE c.c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS verified,
  c.c_custkey % 2000 AS query_id,
  TIMESTAMP '2024-01-30 23:00:00' - (c.c_custkey % 1440) * INTERVAL '1' HOUR AS created_at,
  CASE WHEN c.c_custkey % 37 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' END AS deleted_at
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "proxies": """
SELECT s.s_suppkey AS id, CASE WHEN s.s_suppkey % 5 = 2 THEN 'pool-a' WHEN s.s_suppkey % 5 = 3 THEN '' END AS label,
  CASE s.s_suppkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'https' ELSE 'socks5' END AS scheme,
  concat('10.0.0.', CAST(s.s_suppkey % 250 AS STRING)) AS host, CAST(8000 + s.s_suppkey % 100 AS INT) AS port,
  CASE WHEN s.s_suppkey % 2 = 0 THEN concat('u', CAST(s.s_suppkey AS STRING)) END AS username,
  CASE WHEN s.s_suppkey % 4 = 0 THEN 'secret' END AS password,
  s.s_suppkey % 5 <> 0 AS active, CAST(1 + s.s_suppkey % 3 AS INT) AS priority, n.n_name AS country_code,
  CASE s.s_suppkey % 4 WHEN 0 THEN 'dc' WHEN 1 THEN 'resi' ELSE NULL END AS provider,
  CASE WHEN s.s_suppkey % 17 = 0 THEN NULL ELSE CAST((s.s_suppkey * 37) % 101 AS DOUBLE) / 100 END AS success_rate,
  CAST((s.s_suppkey * 53) % 3000 AS INT) AS response_time_ms,
  CASE WHEN s.s_suppkey % 11 = 0 THEN NULL ELSE CAST((s.s_suppkey * 71) % 2500 AS DOUBLE) END AS average_latency_ms,
  s.s_suppkey * 10 AS total_requests, s.s_suppkey * 6 AS successful_requests, s.s_suppkey * 4 AS failed_requests,
  CAST(s.s_suppkey % 6 AS INT) AS consecutive_failures,
  CASE s.s_suppkey % 8 WHEN 0 THEN 'open' WHEN 1 THEN 'half_open' ELSE 'closed' END AS circuit_breaker_status,
  CASE WHEN s.s_suppkey % 8 = 0 THEN TIMESTAMP '2024-01-30 12:00:00' + (s.s_suppkey % 24) * INTERVAL '1' HOUR END AS circuit_breaker_next_attempt,
  CASE WHEN s.s_suppkey % 7 = 0 THEN TIMESTAMP '2024-01-30 12:00:00' + (s.s_suppkey % 24) * INTERVAL '1' HOUR END AS cooldown_until,
  CASE WHEN s.s_suppkey % 9 = 0 THEN NULL ELSE TIMESTAMP '2024-01-30 23:30:00' - (s.s_suppkey % 240) * INTERVAL '1' HOUR END AS last_used_at,
  CASE WHEN s.s_suppkey % 4 = 1 THEN TIMESTAMP '2024-01-29 00:00:00' - (s.s_suppkey % 48) * INTERVAL '1' HOUR END AS last_failure_at,
  CASE WHEN s.s_suppkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2023-12-15 00:00:00' + (s.s_suppkey % 48) * INTERVAL '1' HOUR END AS last_success_at,
  CASE WHEN s.s_suppkey % 6 <> 0 THEN TIMESTAMP '2023-12-20 00:00:00' + (s.s_suppkey % 24) * INTERVAL '1' HOUR END AS updated_at,
  TIMESTAMP '2023-12-01 00:00:00' + (s.s_suppkey % 60) * INTERVAL '1' DAY AS created_at
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey""",
    "proxy_results": """
SELECT event_id, ts, user_id % 100 AS proxy_id, user_id AS job_id, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 10) AS INT) END AS response_time_ms,
  CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 4 = 0 THEN 429 WHEN event_id % 4 = 1 THEN 403 WHEN event_id % 4 = 2 THEN 503 ELSE NULL END AS status_code,
  CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 5 = 0 THEN 'Timeout after 30s' WHEN event_id % 5 = 1 THEN 'SSL handshake' WHEN event_id % 5 = 2 THEN 'Connection refused' WHEN event_id % 5 = 3 THEN 'captcha wall' ELSE 'boom' END AS message,
  concat('https://site', CAST(user_id % 50 AS STRING), '.acme.org/') AS url
FROM {events}""",
    "system_logs": """
SELECT event_id AS id, ts AS log_ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  CASE event_id % 3 WHEN 0 THEN 'scheduler' WHEN 1 THEN 'spider' ELSE 'dashboard' END AS component,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS job_id, props AS details,
  CAST(event_id % 4 AS INT) AS severity, event_id % 5 = 0 AS resolved FROM {events}""",
    "sessions": """
SELECT c_custkey AS id, concat('site', CAST(c_custkey % 60 AS STRING), '.acme.org') AS domain, c_custkey % 4 <> 0 AS active,
  CASE WHEN c_custkey % 19 = 0 THEN 'cookies' ELSE 'storage_state' END AS type,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE concat('/sessions/', CAST(c_custkey AS STRING), '.json') END AS file_path,
  CASE WHEN c_custkey % 3 = 0 THEN 'imported' END AS notes,
  CASE c_custkey % 7 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'expired' WHEN 3 THEN 'valid' ELSE NULL END AS validation_status,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-30 00:00:00' + (c_custkey % 96) * INTERVAL '1' HOUR END AS expires_at,
  CAST(c_custkey % 30 AS INT) AS usage_count,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE TIMESTAMP '2024-01-30 20:00:00' - (c_custkey % 100) * INTERVAL '1' HOUR END AS last_used_at,
  TIMESTAMP '2024-01-30 23:00:00' - (c_custkey % 72) * INTERVAL '1' HOUR AS created_at,
  CASE WHEN c_custkey % 8 <> 0 THEN TIMESTAMP '2024-01-30 23:30:00' - (c_custkey % 36) * INTERVAL '1' HOUR END AS updated_at,
  CASE WHEN c_custkey % 41 = 0 THEN TIMESTAMP '2024-01-29 00:00:00' END AS deleted_at FROM {customer}""",
    "metrics": """
SELECT event_id, ts, event_type, user_id AS instance, user_id % 25 AS country_key, value,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'in_progress' END AS status FROM {events}""",
    "samples": """
SELECT event_id, ts, metric, CASE WHEN metric = 'dashboard_requests' THEN CASE user_id % 3 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '8.8.8.8' ELSE '172.20.1.1' END
    ELSE concat('n', CAST(user_id % 3 AS STRING)) END AS instance,
  CASE WHEN metric IN ('up', 'db_up', 'dashboard_up') THEN CAST(CASE WHEN floor(event_id / 280) % 3 = 0 THEN 0 ELSE 1 END AS DOUBLE)
    WHEN metric = 'cpu_idle_seconds' THEN CAST(event_id * 2 AS DOUBLE) WHEN metric = 'db_size_bytes' THEN CAST(event_id % 3000 AS DOUBLE) * 10000000
    WHEN metric IN ('jobs_failed', 'jobs_done') THEN floor(event_id / 560) * 100 WHEN metric IN ('jobs_total', 'contacts_extracted') THEN floor(event_id / 56) * 56
    WHEN metric IN ('db_query_seconds', 'contacts_duplicated', 'logins_failed') THEN CAST(event_id % 2800 AS DOUBLE) * 30
    WHEN metric IN ('job_start_time', 'worker_heartbeat') THEN CAST(1704067200 + event_id * 250 AS DOUBLE)
    WHEN metric IN ('mem_total', 'disk_total') THEN CAST(1000 AS DOUBLE) WHEN metric IN ('worker_memory_bytes') THEN CAST(event_id % 4000 AS DOUBLE) * 1000000
    WHEN metric IN ('job_duration_seconds', 'jobs_pending') THEN CAST(event_id % 2500 AS DOUBLE) WHEN metric = 'proxy_success_rate' THEN CAST(event_id % 101 AS DOUBLE) / 100
    ELSE CAST(event_id % 180 AS DOUBLE) END AS value
FROM (SELECT *, CASE event_id % 28 WHEN 0 THEN 'up' WHEN 1 THEN 'cpu_idle_seconds' WHEN 2 THEN 'mem_available' WHEN 3 THEN 'mem_total' WHEN 4 THEN 'disk_available'
  WHEN 5 THEN 'disk_total' WHEN 6 THEN 'db_up' WHEN 7 THEN 'db_connections' WHEN 8 THEN 'db_query_seconds' WHEN 9 THEN 'db_size_bytes' WHEN 10 THEN 'jobs_failed'
  WHEN 11 THEN 'jobs_total' WHEN 12 THEN 'job_start_time' WHEN 13 THEN 'jobs_pending' WHEN 14 THEN 'jobs_done' WHEN 15 THEN 'job_retries' WHEN 16 THEN 'worker_heartbeat'
  WHEN 17 THEN 'worker_memory_bytes' WHEN 18 THEN 'job_duration_seconds' WHEN 19 THEN 'proxies_active' WHEN 20 THEN 'proxy_success_rate' WHEN 21 THEN 'proxy_response_seconds'
  WHEN 22 THEN 'dashboard_up' WHEN 23 THEN 'page_load_seconds' WHEN 24 THEN 'dashboard_users' WHEN 25 THEN 'contacts_extracted' WHEN 26 THEN
  CASE WHEN event_id % 3 = 0 THEN 'contacts_duplicated' ELSE 'logins_failed' END ELSE 'dashboard_requests' END AS metric FROM {events}) e""",
    "seen_urls": """
SELECT p.page_id * 3 + v.visit AS visit_id, p.url AS url, p.page_id AS page_id,
  TIMESTAMP '2024-01-01 00:00:00' + v.visit * INTERVAL '7' DAY + (p.page_id % 48) * INTERVAL '1' HOUR AS visited_at,
  CASE WHEN p.page_id % 6 = 5 THEN NULL ELSE p.page_id % 6 END AS job_id,
  CASE WHEN v.visit = 2 AND p.page_id % 4 = 0 THEN concat(p.html, '!') ELSE p.html END AS content,
  CASE p.page_id % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'pending' ELSE 'processed' END AS processing_status,
  CASE p.page_id % 10 WHEN 0 THEN 'duplicate' WHEN 5 THEN 'robots' ELSE NULL END AS skip_reason
FROM {pages} p LATERAL VIEW explode(array(0, 1, 2)) v AS visit""",
    "job_runs": """
SELECT o_orderkey AS id, o_custkey AS job_id, o_orderdate AS started_at,
  o_orderdate + (o_orderkey % 180) * INTERVAL '1' MINUTE AS finished_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'cancelled' END AS status,
  o_orderkey % 40 AS pages, o_orderkey % 13 AS contacts, o_orderkey % 4 AS errors,
  CASE o_orderkey % 4 WHEN 0 THEN 'crawl' WHEN 1 THEN 'extract' WHEN 2 THEN 'clean' ELSE 'merge' END AS phase,
  o_orderdate + (o_orderkey % 500) * INTERVAL '1' DAY AS valid_until, o_orderkey % 3 <> 0 AS is_active
FROM {orders}""",
    "raw_urls": """
SELECT page_id, url, CASE page_id % 12 WHEN 0 THEN concat('HTTP', substring(url, instr(url, ':'), 400)) WHEN 1 THEN concat(url, '&z=%41%2f+b&a=1&c=&b=~*')
  WHEN 2 THEN concat(url, '?b=2&&a=1&a=0&c') WHEN 3 THEN substring(url, 1, instr(url, '.'))
  WHEN 4 THEN '' WHEN 5 THEN substring(url, instr(url, ':') + 3, 400) WHEN 6 THEN concat('//', 'Host', CAST(page_id AS STRING), '.org/x;p=1?é=ü')
  WHEN 7 THEN NULL WHEN 8 THEN 'https://localhost:8080/x y' WHEN 9 THEN concat('http://10.0.0.', CAST(page_id AS STRING), '/a.PDF')
  WHEN 10 THEN concat('https://Shop', CAST(page_id AS STRING), '.acme.org?q=a b') ELSE url END AS raw,
  CASE page_id % 15 WHEN 0 THEN '../x/./y' WHEN 1 THEN 'z?q=1' WHEN 2 THEN '//h.org/p' WHEN 3 THEN '#f' WHEN 4 THEN '?q=2#g' WHEN 5 THEN 'http://o.org/x'
    WHEN 6 THEN '' WHEN 7 THEN '/a/../b/c.pdf' WHEN 8 THEN './' WHEN 9 THEN 'mailto:a@acme.org' WHEN 10 THEN '/contact' WHEN 11 THEN '../../..'
    WHEN 12 THEN 'a/b/../../c?x=1#y' WHEN 13 THEN '..' ELSE concat('/p', CAST(page_id AS STRING)) END AS href
FROM {pages}""",
    "corpus": """
SELECT d.doc_id AS doc_id, concat(p.url, '') AS url,
  concat(d.text, ' Contact: Marie Dubois, Dubois Consulting, ', 'Ada.', CAST(d.doc_id % 300 AS STRING), '@mail',
    CAST(d.doc_id % 7 AS STRING), '.acme.org +33 1 23 45 67 ', CAST(10 + d.doc_id % 90 AS STRING)) AS text,
  d.doc_id % 200 AS query_id
FROM (SELECT doc_id, text, doc_id % (SELECT count(*) FROM {pages}) AS place FROM {documents}) d
JOIN (SELECT page_id, url FROM {pages}) p ON p.page_id = d.place""",
}

ORACLE = dict(SQL)
ORACLE["seen_urls"] = SQL["seen_urls"].replace(
    "LATERAL VIEW explode(array(0, 1, 2)) v AS visit", ", (SELECT unnest([0, 1, 2]) AS visit) v"
)


class Tables:
    """Given tables and projections of one scale folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @functools.cache
    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.dealt(name) if name in TEXTS else self.scan(name)
        if name not in SQL:
            raise AttributeError(name)
        used = {t: self.scan(t) for t in BASE if "{" + t + "}" in SQL[name]}
        if name in TEXTS:  # the table that leads the projection
            lead = "documents" if "documents" in used else "orders"
            used[lead] = self.dealt(lead)
        return self.spark.sql(SQL[name], **used)

    def dealt(self, name: str) -> DataFrame:
        """Rows as they are stored, or over as many parts as the session sets: a few small files keep few cores busy."""
        parts = self.spark.conf.get(PARTS, None)
        return self.scan(name).repartition(int(parts)) if parts else self.scan(name)

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def oracle(sql: str) -> str:
    """Put the projections a statement names in front of it as common table expressions."""
    body = sql.strip()
    named = [n for n in ORACLE if f" {n} " in f" {body} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
    ctes = ", ".join(f"{n} AS ({ORACLE[n].format(**{t: t for t in BASE})})" for n in named)
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        recursive = rest[:10].upper() == "RECURSIVE "
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}, {rest[10:] if recursive else rest}"
    return f"WITH {ctes} {body}"
