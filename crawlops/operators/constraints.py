"""Constraints of the operational tables as data: value domains, keys and foreign keys."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlops.operators.quality import dq_domain_violations, dq_duplicates, dq_orphans

# Fixed values: (table, rule, what is allowed); NULL is allowed everywhere.
DOMAINS = [
    ("queue", "status", "status IN ('pending', 'in_progress', 'done', 'failed', 'paused')"),
    ("queue", "match_mode", "match_mode IN ('any', 'multiple', 'all')"),
    ("queue", "proxy_rotation_mode", "proxy_rotation_mode IN ('per_spider', 'per_request', 'sticky')"),
    ("queue", "retry_strategy", "retry_strategy IN ('exponential', 'linear', 'fixed')"),
    ("contacts", "enrichment_status", "enrichment_status IN ('pending', 'done', 'failed')"),
    ("contacts", "confidence_score", "confidence_score >= 0.0 AND confidence_score <= 1.0"),
    ("proxies", "scheme", "scheme IN ('http', 'https', 'socks5')"),
    ("proxies", "port", "port > 0 AND port <= 65535"),
    ("proxies", "success_rate", "success_rate >= 0.0 AND success_rate <= 1.0"),
    ("proxies", "last_test_status", "last_test_status IN ('success', 'failed', 'timeout')"),
    ("proxies", "weight", "weight > 0"),
    ("proxies", "rps_max", "rps_max > 0"),
    ("proxies", "circuit_breaker_status", "circuit_breaker_status IN ('closed', 'open', 'half_open')"),
    ("sessions", "type", "type IN ('storage_state', 'cookies', 'headers')"),
    ("sessions", "browser_type", "browser_type IN ('chromium', 'firefox', 'webkit')"),
    ("sessions", "validation_status", "validation_status IN ('valid', 'invalid', 'expired')"),
    ("settings", "value_type", "value_type IN ('string', 'integer', 'float', 'boolean', 'json')"),
    ("system_logs", "level", "level IN ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL')"),
    ("seen_urls", "processing_status", "processing_status IN ('pending', 'processing', 'done', 'failed', 'skipped')"),
    ("job_runs", "status", "status IN ('running', 'completed', 'failed', 'cancelled', 'timeout')"),
    ("job_checkpoints", "phase", "phase IN ('search', 'listing', 'detail', 'download')"),
    ("proxy_stats", "hour_of_day", "hour_of_day >= 0 AND hour_of_day <= 23"),
]
# Fixed values: (table, unique columns, rows it holds for).
KEYS = [
    ("contacts", ["email"], "deleted_at IS NULL"),
    ("proxies", ["scheme", "host", "port", "username"], "true"),
    ("settings", ["key"], "true"),
    ("seen_urls", ["url"], "true"),
    ("seen_urls", ["url_hash"], "true"),
    ("job_checkpoints", ["job_id", "run_id", "phase"], "is_active"),
    ("proxy_stats", ["proxy_id", "measurement_date", "hour_of_day"], "true"),
]
EMPTY = {"username"}  # a key column in which NULL is a value like any other
# Fixed values: (table, column, table it points to); the target is the column id.
FOREIGN = [
    ("contacts", "query_id", "queue"), ("contacts", "duplicate_of", "contacts"), ("seen_urls", "job_id", "queue"),
    ("job_runs", "job_id", "queue"), ("job_checkpoints", "job_id", "queue"), ("job_checkpoints", "run_id", "job_runs"),
    ("proxy_stats", "proxy_id", "proxies"),
]

Found = Callable[[str], DataFrame | None]


def check_domains(table: Found) -> DataFrame:
    """``table_name, rule, violations`` of all value domains, one pass per table."""
    parts = []
    for name in dict.fromkeys(t for t, _, _ in DOMAINS):
        df = table(name)
        rules = {rule: F.expr(ok) for t, rule, ok in DOMAINS if t == name and df is not None and rule in df.columns}
        if rules:
            parts.append(dq_domain_violations(df, rules).select(F.lit(name).alias("table_name"), "rule", "violations"))
    return functools.reduce(DataFrame.unionByName, parts)


def check_keys(table: Found) -> DataFrame:
    """``table_name, rule, violations``: values of unique columns that occur more than once."""
    parts = []
    for name, columns, where in KEYS:
        df = table(name)
        if df is not None and set(columns) <= set(df.columns):
            keys = {c: F.coalesce(F.col(c), F.lit("")) if c in EMPTY else F.col(c) for c in columns}
            twice = dq_duplicates(df, keys, F.expr(where))
            parts.append(twice.groupBy().agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(name).alias("table_name"), F.lit("+".join(columns)).alias("rule"), "violations"
            ))
    return functools.reduce(DataFrame.unionByName, parts)


def check_foreign(table: Found) -> DataFrame:
    """``table_name, rule, violations``: rows whose filled foreign key has no parent."""
    parts = []
    for name, column, parent in FOREIGN:
        child, target = table(name), table(parent)
        if child is not None and target is not None and column in child.columns:
            lost = dq_orphans(child.select(column), target, column, "id")
            parts.append(lost.groupBy().agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(name).alias("table_name"), F.lit(f"{column} -> {parent}").alias("rule"), "violations"
            ))
    return functools.reduce(DataFrame.unionByName, parts)
