"""Declared schemas of the operational tables and of the event log."""

from __future__ import annotations

# Names and types of the stored columns.

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
QUEUE = """id bigint, url string, country_filter string, lang_filter string, theme string, status string, priority int,
    retry_count int, max_retries int, last_error string, next_retry_at timestamp_ntz, execution_time_seconds int,
    contacts_extracted int, custom_keywords array<string>, match_mode string, min_matches int, use_js boolean,
    max_pages_per_domain int, created_by string, created_at timestamp_ntz, updated_at timestamp_ntz,
    deleted_at timestamp_ntz, last_run_at timestamp_ntz, min_rerun_hours int, checkpoint_data string, phase_status string"""
CONTACTS = """id bigint, name string, org string, email string, languages string, phone string, country string, url string,
    theme string, source string, page_lang string, raw_text string, query_id bigint, seed_url string, verified boolean,
    confidence_score double, tags array<string>, created_at timestamp_ntz, updated_at timestamp_ntz,
    deleted_at timestamp_ntz, contact_hash string, duplicate_of bigint, is_primary boolean, merge_count int"""
PROXIES = """id bigint, label string, scheme string, host string, port int, username string, password string, active boolean,
    priority int, success_rate double, response_time_ms int, average_latency_ms decimal(10,4), total_requests int,
    successful_requests int, failed_requests int, consecutive_failures int, last_used_at timestamp_ntz,
    last_success_at timestamp_ntz, last_failure_at timestamp_ntz, cooldown_until timestamp_ntz,
    circuit_breaker_status string, circuit_breaker_failures int, circuit_breaker_last_failure timestamp_ntz,
    circuit_breaker_next_attempt timestamp_ntz, weight int, rps_max decimal(5,2), country_code string, provider string,
    created_at timestamp_ntz, updated_at timestamp_ntz"""
SESSIONS = """id bigint, domain string, type string, file_path string, active boolean, validation_status string,
    expires_at timestamp_ntz, usage_count int, last_used_at timestamp_ntz, last_validated_at timestamp_ntz,
    browser_type string, user_agent string, notes string, created_at timestamp_ntz, updated_at timestamp_ntz,
    deleted_at timestamp_ntz"""
SETTINGS = "key string, value string, value_type string, description string, category string, updated_at timestamp_ntz"
SYSTEM_LOGS = """id bigint, log_ts timestamp_ntz, level string, component string, job_id bigint, message string, details string,
    severity int, resolved boolean"""
SEEN_URLS = """id bigint, url string, normalized_url string, url_hash string, domain string, path_hash string,
    content_hash string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, visit_count int, job_id bigint,
    processing_status string, skip_reason string, next_revisit_after timestamp_ntz"""
ERROR_EVENTS = "id bigint, source string, category string, message string, proxy_id bigint, url string, status_code int, created_at timestamp_ntz"
JOB_RUNS = """id bigint, job_id bigint, run_number int, started_at timestamp_ntz, finished_at timestamp_ntz, status string,
    pages_crawled int, contacts_extracted int, errors_count int, requests_count int, data_downloaded_bytes bigint"""
JOB_CHECKPOINTS = """id bigint, job_id bigint, run_id bigint, phase string, checkpoint_key string, pages_processed int,
    items_processed int, checkpoint_at timestamp_ntz, valid_until timestamp_ntz, is_active boolean"""
PROXY_STATS = """proxy_id bigint, date date, hour int, request_count bigint, success_count bigint, fail_count bigint,
    timeout_count bigint, total_response_ms bigint, min_response_ms int, max_response_ms int, avg_response_ms double,
    http_4xx_count bigint, http_5xx_count bigint, rate_limited_count bigint, captcha_count bigint, blocked_count bigint"""
TABLES = {
    "queue": QUEUE, "contacts": CONTACTS, "proxies": PROXIES, "sessions": SESSIONS, "settings": SETTINGS,
    "system_logs": SYSTEM_LOGS, "seen_urls": SEEN_URLS, "error_events": ERROR_EVENTS, "job_runs": JOB_RUNS,
    "job_checkpoints": JOB_CHECKPOINTS, "proxy_stats": PROXY_STATS,
}
