"""Constraints over all operational tables, each rule spelled out again in the SQL that checks it."""

from __future__ import annotations

from crawlops.catalog.registry import query
from crawlops.fixtures import SQL
from crawlops.operators import constraints


def tables(t):
    return lambda name: getattr(t, name) if name in SQL else None


def sql_broken(table: str, *rules: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{name}' AS rule, count(*) AS violations FROM {table} WHERE NOT ({ok})" for name, ok in rules)


BROKEN = " UNION ALL ".join([
    sql_broken("queue", ("status", "status IN ('pending', 'in_progress', 'done', 'failed', 'paused')"), ("match_mode", "match_mode IN ('any', 'multiple', 'all')")),
    sql_broken("proxies", ("scheme", "scheme IN ('http', 'https', 'socks5')"), ("port", "port BETWEEN 1 AND 65535"), ("success_rate", "success_rate BETWEEN 0 AND 1"),
               ("circuit_breaker_status", "circuit_breaker_status IN ('closed', 'open', 'half_open')")),
    sql_broken("sessions", ("type", "type IN ('storage_state', 'cookies', 'headers')"), ("validation_status", "validation_status IN ('valid', 'invalid', 'expired')")),
    sql_broken("system_logs", ("level", "level IN ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL')")),
    sql_broken("seen_urls", ("processing_status", "processing_status IN ('pending', 'processing', 'done', 'failed', 'skipped')")),
    sql_broken("job_runs", ("status", "status IN ('running', 'completed', 'failed', 'cancelled', 'timeout')")),
])


@query("dq_all_domains", f"SELECT * FROM ({BROKEN}) WHERE violations > 0")
def _(t):
    return constraints.check_domains(tables(t))


@query("dq_all_keys", """
SELECT 'contacts' AS table_name, 'email' AS rule, count(*) AS violations FROM (SELECT email FROM contacts WHERE deleted_at IS NULL AND email IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'proxies', 'scheme+host+port+username', count(*) FROM (SELECT 1 FROM proxies GROUP BY scheme, host, port, coalesce(username, '') HAVING count(*) > 1)
UNION ALL SELECT 'seen_urls', 'url', count(*) FROM (SELECT 1 FROM seen_urls WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1)""")
def _(t):
    return constraints.check_keys(tables(t))


@query("dq_all_foreign", """
SELECT 'contacts' AS table_name, 'query_id -> queue' AS rule, count(*) AS violations FROM contacts WHERE query_id IS NOT NULL AND query_id NOT IN (SELECT id FROM queue )
UNION ALL SELECT 'seen_urls', 'job_id -> queue', count(*) FROM seen_urls WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT id FROM queue )
UNION ALL SELECT 'job_runs', 'job_id -> queue', count(*) FROM job_runs WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT id FROM queue )""")
def _(t):
    return constraints.check_foreign(tables(t))


# Tables with the columns that the projections lack, so that every rule meets one, and violations in them; the same text runs in Spark and in the check.
PLANTED = {
    "queue": """SELECT *, CASE id % 7 WHEN 0 THEN 'random' WHEN 1 THEN NULL ELSE 'sticky' END AS proxy_rotation_mode,
      CASE id % 5 WHEN 0 THEN 'never' ELSE 'linear' END AS retry_strategy FROM {queue}""",
    "contacts": """SELECT *, CASE id % 11 WHEN 0 THEN 'lost' WHEN 1 THEN NULL ELSE 'done' END AS enrichment_status,
      CAST(id % 13 AS DOUBLE) / 10 AS confidence_score, CASE id % 10 WHEN 0 THEN id + 100000000 WHEN 1 THEN id END AS duplicate_of FROM {contacts}""",
    "proxies": """SELECT *, CASE id % 3 WHEN 0 THEN 'unknown' ELSE 'timeout' END AS last_test_status, CAST(id % 4 AS INT) AS weight,
      CAST(id % 5 AS DOUBLE) - 1 AS rps_max FROM {proxies}""",
    "sessions": "SELECT *, CASE id % 4 WHEN 0 THEN 'ie' WHEN 1 THEN NULL ELSE 'webkit' END AS browser_type FROM {sessions}",
    "settings": """SELECT concat('key', CAST(event_id % 400 AS STRING)) AS key, CASE event_id % 6 WHEN 0 THEN 'date' WHEN 1 THEN 'json' ELSE 'string' END AS value_type
      FROM {events} WHERE event_id % 3 = 0""",
    "system_logs": "SELECT * FROM {system_logs}",
    "seen_urls": "SELECT *, md5(concat('u', CAST(page_id % 20 AS STRING))) AS url_hash FROM {seen_urls}",
    "job_runs": "SELECT * FROM {job_runs}",
    "job_checkpoints": """SELECT event_id AS id, event_id % 900 AS job_id, CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 700 END AS run_id,
      CASE event_id % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'listing' WHEN 2 THEN 'detail' WHEN 3 THEN 'paused' ELSE 'download' END AS phase,
      event_id % 2 = 0 AS is_active FROM {events}""",
    "proxy_stats": """SELECT event_id % 40 AS proxy_id, CAST(ts AS DATE) AS measurement_date, CAST(event_id % 26 AS INT) - 1 AS hour_of_day FROM {events}""",
}


def planted(t):
    names = dict.fromkeys(n for n in (*SQL, "events"))
    return lambda name: t.spark.sql(PLANTED[name], **{n: getattr(t, n) for n in names if "{" + n + "}" in PLANTED[name]}) if name in PLANTED else None


def sql_planted(statement: str) -> str:
    tables = ", ".join(f"p_{name} AS ({sql.format_map(Same())})" for name, sql in PLANTED.items())
    return f"WITH {tables} {statement}"


class Same(dict):
    """Names stand for themselves, with a space behind as projections are known by it."""

    def __missing__(self, name: str) -> str:
        return f"{name} "


IN_DOMAIN = {
    "queue": {
        "status": "IN ('pending', 'in_progress', 'done', 'failed', 'paused')", "match_mode": "IN ('any', 'multiple', 'all')",
        "proxy_rotation_mode": "IN ('per_spider', 'per_request', 'sticky')", "retry_strategy": "IN ('exponential', 'linear', 'fixed')",
    },
    "contacts": {"enrichment_status": "IN ('pending', 'done', 'failed')", "confidence_score": "BETWEEN 0 AND 1"},
    "proxies": {
        "scheme": "IN ('http', 'https', 'socks5')", "port": "BETWEEN 1 AND 65535", "success_rate": "BETWEEN 0 AND 1",
        "last_test_status": "IN ('success', 'failed', 'timeout')", "weight": "> 0", "rps_max": "> 0",
        "circuit_breaker_status": "IN ('closed', 'open', 'half_open')",
    },
    "sessions": {
        "type": "IN ('storage_state', 'cookies', 'headers')", "browser_type": "IN ('chromium', 'firefox', 'webkit')",
        "validation_status": "IN ('valid', 'invalid', 'expired')",
    },
    "settings": {"value_type": "IN ('string', 'integer', 'float', 'boolean', 'json')"},
    "system_logs": {"level": "IN ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL')"},
    "seen_urls": {"processing_status": "IN ('pending', 'processing', 'done', 'failed', 'skipped')"},
    "job_runs": {"status": "IN ('running', 'completed', 'failed', 'cancelled', 'timeout')"},
    "job_checkpoints": {"phase": "IN ('search', 'listing', 'detail', 'download')"},
    "proxy_stats": {"hour_of_day": "BETWEEN 0 AND 23"},
}
OUTSIDE = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) AS violations FROM p_{table} WHERE NOT ({rule} {ok})"
    for table, rules in IN_DOMAIN.items() for rule, ok in rules.items()
)


@query("dq_planted_domains", sql_planted(f"SELECT * FROM ({OUTSIDE}) WHERE violations > 0"))
def _(t):
    return constraints.check_domains(planted(t))


def sql_twice(table: str, columns: list[str], keys: str, where: str = "TRUE") -> str:
    return f"SELECT '{table}' AS table_name, '{'+'.join(columns)}' AS rule, count(*) AS violations FROM (SELECT 1 FROM p_{table} WHERE {where} GROUP BY {keys} HAVING count(*) > 1)"


TWICE = " UNION ALL ".join([
    sql_twice("contacts", ["email"], "email", "deleted_at IS NULL AND email IS NOT NULL"),
    sql_twice("proxies", ["scheme", "host", "port", "username"], "scheme, host, port, coalesce(username, '')"),
    sql_twice("settings", ["key"], "key"), sql_twice("seen_urls", ["url"], "url", "url IS NOT NULL"), sql_twice("seen_urls", ["url_hash"], "url_hash"),
    sql_twice("job_checkpoints", ["job_id", "run_id", "phase"], "job_id, run_id, phase", "is_active AND run_id IS NOT NULL"),
    sql_twice("proxy_stats", ["proxy_id", "measurement_date", "hour_of_day"], "proxy_id, measurement_date, hour_of_day"),
])


@query("dq_planted_keys", sql_planted(TWICE))
def _(t):
    return constraints.check_keys(planted(t))


def sql_lost(child: str, column: str, parent: str) -> str:
    return f"SELECT '{child}' AS table_name, '{column} -> {parent}' AS rule, count(*) AS violations FROM p_{child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM p_{parent} WHERE id IS NOT NULL)"


LOST = " UNION ALL ".join([
    sql_lost("contacts", "query_id", "queue"), sql_lost("contacts", "duplicate_of", "contacts"), sql_lost("seen_urls", "job_id", "queue"),
    sql_lost("job_runs", "job_id", "queue"), sql_lost("job_checkpoints", "job_id", "queue"), sql_lost("job_checkpoints", "run_id", "job_runs"),
    sql_lost("proxy_stats", "proxy_id", "proxies"),
])


@query("dq_planted_foreign", sql_planted(LOST))
def _(t):
    return constraints.check_foreign(planted(t))
