"""Merges, jobs, proxies, crawl and whole pipelines, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlops.catalog.functions import (
    DOMAIN, EV, ES, HASH, PHONES, SPIDER_SQL, SQL_NAME, SQL_ORG, q, sql_around, sql_field, sql_join, sql_normalize, sql_strip,
)
from crawlops.catalog.registry import query
from crawlops.catalog.reports import BY_COUNTRY, ELIGIBLE, FULL_ORDER, JT, NT, SIMPLE, SIMPLE_ORDER
from crawlops.fixtures import AS_OF, JOBS_AS_OF
from crawlops.functions import contact, text, urls
from crawlops.operators import jobs, merge, proxies, reports
from crawlops.plans import extract, frontier
from crawlops.session import scratch
from crawlops.sources import sinks

# ------------------------------------------------------------------ sinks


@query("sink_csv", "SELECT id, name, email, country FROM contacts WHERE deleted_at IS NULL")
def _(t):
    path = scratch(t.spark, "csv")
    sinks.write_csv(t.contacts.where("deleted_at IS NULL").select("id", "name", "email", "country"), path)
    return t.spark.read.schema("id bigint, name string, email string, country string").csv(path, header=True)


@query("sink_email_list", "SELECT email AS value FROM contact_items WHERE email IS NOT NULL")
def _(t):
    path = scratch(t.spark, "emails")
    sinks.write_emails(t.contact_items, path)
    return t.spark.read.text(path)


@query("sink_snapshot", BY_COUNTRY)
def _(t):
    path = scratch(t.spark, "snapshot")
    sinks.refresh_snapshot(reports.contacts_by_country(t.contacts.where("false"), AS_OF), path, "2024-01-30 00:00:00")
    sinks.refresh_snapshot(reports.contacts_by_country(t.contacts, AS_OF), path, AS_OF)
    return sinks.read_snapshot(t.spark, path)


# ------------------------------------------------------------------ settings, proxies, seen URLs

KINDS = "CASE c_custkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'float' WHEN 3 THEN 'boolean' ELSE 'json' END"
VALUES = """CASE c_custkey % 10 WHEN 0 THEN c_name WHEN 1 THEN CAST(c_custkey AS STRING) WHEN 2 THEN CAST(c_custkey % 8 AS STRING) || '.5' WHEN 3 THEN 'true'
  WHEN 4 THEN '{"a":1}' WHEN 5 THEN '' WHEN 6 THEN 'n/a' WHEN 7 THEN '1e3' WHEN 8 THEN 'maybe' ELSE '{bad' END"""


def settings(t, where: str, value: str = VALUES):
    return t.customer.where(where).select(
        F.expr("concat('k', CAST(c_custkey AS STRING))").alias("key"), F.expr(value).alias("value"), F.expr(KINDS).alias("value_type")
    )


def sql_settings(where: str, value: str = VALUES) -> str:
    return f"SELECT concat('k', CAST(c_custkey AS STRING)) AS key, {value} AS value, {KINDS} AS value_type FROM customer WHERE {where}"


@query("settings_typed", f"""
WITH s AS ({sql_settings('TRUE')})
SELECT key, value, value_type, CASE WHEN value_type = 'string' THEN value END AS string_value,
  CASE WHEN value_type = 'integer' AND regexp_matches(value, '^[0-9]+$') THEN CAST(value AS BIGINT) END AS integer_value,
  CASE WHEN value_type = 'float' THEN TRY_CAST(value AS DOUBLE) END AS float_value,
  CASE WHEN value_type = 'boolean' THEN TRY_CAST(value AS BOOLEAN) END AS boolean_value,
  CASE WHEN value_type = 'json' AND json_valid(value) THEN value END AS json_value FROM s""")
def _(t):
    return merge.typed_settings(settings(t, "true"))


@query("settings_merge", f"""
WITH o AS ({sql_settings('c_custkey % 3 < 2')}), n AS ({sql_settings('c_custkey % 3 > 0', "'new'")})
SELECT * FROM o UNION ALL SELECT * FROM n WHERE key NOT IN (SELECT key FROM o)""")
def _(t):
    return merge.merge_settings(settings(t, "c_custkey % 3 < 2"), settings(t, "c_custkey % 3 > 0", "'new'"))


@query("settings_replace", f"""
WITH o AS ({sql_settings('c_custkey % 3 < 2')}), n AS ({sql_settings('c_custkey % 3 > 0', "'new'")})
SELECT * FROM n UNION ALL SELECT * FROM o WHERE key NOT IN (SELECT key FROM n)""")
def _(t):
    return merge.merge_settings(settings(t, "c_custkey % 3 < 2"), settings(t, "c_custkey % 3 > 0", "'new'"), "replace")


NEW_PROXIES = """SELECT c_custkey AS ord, CASE c_custkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'https' ELSE 'socks5' END AS scheme,
  concat('10.0.0.', CAST(c_custkey % 150 AS STRING)) AS host, CAST(8000 + c_custkey % 150 AS INT) AS port,
  CASE WHEN c_custkey % 2 = 0 THEN concat('u', CAST(c_custkey % 150 AS STRING)) END AS username, 'pw' AS password, c_custkey % 4 > 0 AS active FROM {customer}"""


@query("proxy_upsert", f"""
WITH n AS ({NEW_PROXIES.format(customer='customer')}),
l AS (SELECT scheme, host, port, coalesce(username, '') AS u, arg_max(active, ord) AS active, arg_min(password, ord) AS password FROM n GROUP BY ALL),
o AS (SELECT *, coalesce(username, '') AS u FROM proxies )
SELECT o.id, coalesce(o.scheme, l.scheme) AS scheme, coalesce(o.host, l.host) AS host, coalesce(o.port, l.port) AS port,
  nullif(coalesce(o.u, l.u), '') AS username, coalesce(l.active, o.active) AS active, CASE WHEN o.id IS NULL THEN l.password ELSE o.password END AS password,
  CASE WHEN l.host IS NOT NULL THEN {NT} ELSE o.updated_at END AS updated_at
FROM o FULL JOIN l ON o.scheme = l.scheme AND o.host = l.host AND o.port = l.port AND o.u = l.u""")
def _(t):
    new = t.spark.sql(NEW_PROXIES, customer=t.customer)
    return merge.merge_proxies(t.proxies, new, AS_OF).select(
        "id", "scheme", "host", "port", "username", "active", "password", "updated_at"
    )


CANDIDATES = "SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN 0 ELSE page_id % 6 END AS job_id FROM {pages}"


def candidates(t):
    return t.spark.sql(CANDIDATES, pages=t.scan("pages"))


SCOPE = "CASE WHEN coalesce(job_id, 0) = 0 THEN 'global' ELSE CAST(job_id AS VARCHAR) END"


@query("seen_filter", f"""
WITH c AS (SELECT *, {SCOPE} AS scope, {sql_normalize('url')} AS n FROM ({CANDIDATES.format(pages='pages')})),
s AS (SELECT DISTINCT {SCOPE} AS scope, {sql_normalize('url')} AS n FROM seen_urls )
SELECT page_id, scope, n AS normalized_url FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.scope = c.scope AND s.n = c.n)""")
def _(t):
    return merge.unseen(candidates(t), t.seen_urls).select("page_id", "scope", "normalized_url")


SEEN_UPSERT = f"""
WITH o AS (SELECT url, min(visited_at) AS f, max(visited_at) AS l, count(*) AS n FROM seen_urls WHERE page_id % 3 < 2 GROUP BY 1),
b AS (SELECT url, min(visited_at) AS f, max(visited_at) AS l, count(*) AS n FROM (SELECT url, visited_at + INTERVAL '40' DAY AS visited_at FROM seen_urls WHERE page_id % 3 > 0) GROUP BY 1)
SELECT coalesce(o.url, b.url) AS url, {sql_normalize('coalesce(o.url, b.url)')} AS normalized_url, coalesce(o.f, b.f) AS first_seen_at,
  greatest(o.l, b.l) AS last_seen_at, coalesce(o.n, 0) + coalesce(b.n, 0) AS visit_count, CASE WHEN o.url IS NOT NULL THEN 'processed' END AS processing_status,
  CASE WHEN o.url IS NOT NULL THEN md5(o.url) END AS url_hash FROM o FULL JOIN b ON o.url = b.url"""


@query("seen_upsert", SEEN_UPSERT)
def _(t):
    empty = t.seen_urls.where("false").select(
        "url", F.col("url").alias("normalized_url"), F.col("visited_at").alias("first_seen_at"),
        F.col("visited_at").alias("last_seen_at"), F.lit(0).cast("bigint").alias("visit_count"),
    )
    base = merge.merge_seen(empty, t.seen_urls.where("page_id % 3 < 2"))
    base = base.withColumns({"processing_status": F.lit("processed"), "url_hash": F.md5("url")})
    later = t.seen_urls.where("page_id % 3 > 0").withColumn("visited_at", F.expr("visited_at + INTERVAL '40' DAY"))
    return merge.merge_seen(base, later)


@query("content_changes", f"""
WITH v AS (SELECT visit_id, visited_at, sha256({sql_normalize('url')}) AS url_hash, sha256(content) AS content_hash FROM seen_urls ),
l AS (SELECT *, lag(content_hash) OVER (PARTITION BY url_hash ORDER BY visited_at, visit_id) AS previous_hash FROM v)
SELECT visit_id, url_hash, content_hash, previous_hash FROM l WHERE previous_hash <> content_hash""")
def _(t):
    visits = t.seen_urls.select(
        "visit_id", "visited_at", F.sha2(urls.url_normalize("url"), 256).alias("url_hash"), text.content_hash("content").alias("content_hash")
    )
    return jobs.content_changes(visits).select("visit_id", "url_hash", "content_hash", "previous_hash")


# ------------------------------------------------------------------ contacts

MAIL = sql_strip("email")
NAME = sql_field("name", 255)
WORDS = "trim(regexp_replace(regexp_replace(split_part(email, '@', 1), '[._+-]+', ' ', 'g'), '[0-9]+', '', 'g'))"
DERIVED = f"""(CASE WHEN contains(email, '@') AND regexp_matches(replace({WORDS}, ' ', ''), '^\\p{{L}}{{2,}}$') AND contains({WORDS}, ' ') THEN
  nullif(array_to_string(list_transform(list_filter(regexp_split_to_array({WORDS}, ' +'), lambda x: length(x) > 1), lambda x: upper(x[1]) || lower(substring(x, 2))), ' '), '') END)"""
CLEAN = f"""SELECT item_id, seen_at, query_id, {MAIL} AS m, coalesce({NAME}, CASE WHEN contains({DERIVED}, ' ') THEN {DERIVED} END) AS name,
  coalesce(regexp_matches({MAIL}, {q(EV)}) AND NOT regexp_matches(lower(email), {q(ES)}), FALSE) AS ok,
  {sql_field('org', 200)} AS org, {sql_field('phone', 30)} AS phone, {sql_field('country', 100)} AS country,
  CASE WHEN regexp_matches({sql_strip('url')}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN substring({sql_strip('url')}, 1, 500) END AS url FROM contact_items """
VERDICT = "CASE WHEN NOT ok THEN 'invalid_email' WHEN name IS NULL THEN 'no_name' ELSE 'valid' END"


@query("clean_items", f"""
WITH c AS ({CLEAN}) SELECT item_id, {VERDICT} AS verdict, lower(m) AS email, name, org, phone, country, url, 'Scraper' AS source FROM c""")
def _(t):
    return merge.clean_items(t.contact_items).select("item_id", "verdict", "email", "name", "org", "phone", "country", "url", "source")


FOLDED = f"""v AS (SELECT *, lower(m) AS email FROM ({CLEAN}) WHERE ok AND name IS NOT NULL),
f AS (SELECT email, first(name ORDER BY length(name) DESC, seen_at, item_id) AS name, last(org ORDER BY seen_at, item_id) FILTER (WHERE org IS NOT NULL) AS org,
  last(phone ORDER BY seen_at, item_id) FILTER (WHERE phone IS NOT NULL) AS phone, last(country ORDER BY seen_at, item_id) FILTER (WHERE country IS NOT NULL) AS country,
  last(url ORDER BY seen_at, item_id) FILTER (WHERE url IS NOT NULL) AS url, last(query_id ORDER BY seen_at, item_id) AS query_id, count(*) AS items FROM v GROUP BY 1)"""
# the stored contacts of the merge: earlier copies of every third address
BASE = """SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'Ad' ELSE 'A very long stored name of this person' END AS name,
  CASE WHEN c_custkey % 4 = 0 THEN 'Old org' END AS org,
  lower(concat('Ada.', c_mktsegment, '_', CAST(c_custkey AS STRING), '@mail', CAST(c_custkey % 7 AS STRING), '.acme.org')) AS email,
  '1 2 3 4' AS phone, CAST(NULL AS STRING) AS country, 'https://old.acme.org/' AS url, CAST(NULL AS BIGINT) AS query_id,
  TIMESTAMP '1990-01-01 00:00:00' AS created_at, CASE WHEN c_custkey % 33 = 0 THEN TIMESTAMP '1991-01-01 00:00:00' END AS deleted_at
FROM {customer} WHERE c_custkey % 3 = 0"""


def stored(t):
    return t.spark.sql(BASE, customer=t.customer)


MERGED = f"""
WITH b AS ({BASE.format(customer='customer')}), o AS (SELECT * FROM b WHERE deleted_at IS NULL), {FOLDED}
SELECT o.id, coalesce(f.email, o.email) AS email, CASE WHEN length(f.name) > length(coalesce(o.name, '')) THEN f.name ELSE o.name END AS name,
  coalesce(f.org, o.org) AS org, coalesce(f.phone, o.phone) AS phone, coalesce(f.country, o.country) AS country, coalesce(f.url, o.url) AS url,
  coalesce(f.query_id, o.query_id) AS query_id, CASE WHEN o.id IS NULL THEN {JT} ELSE o.created_at END AS created_at, o.deleted_at,
  CASE WHEN o.id IS NULL THEN 'insert' WHEN f.email IS NULL THEN 'keep' ELSE 'update' END AS action, coalesce(f.items, 0) AS items,
  CASE WHEN f.email IS NOT NULL THEN {JT} END AS updated_at
FROM o FULL JOIN f ON o.email = f.email
UNION ALL SELECT id, email, name, org, phone, country, url, query_id, created_at, deleted_at, 'keep', 0, NULL FROM b WHERE deleted_at IS NOT NULL"""
SHOWN = ["id", "email", "name", "org", "phone", "country", "url", "query_id", "created_at", "deleted_at", "action", "items", "updated_at"]


@query("contact_upsert", MERGED)
def _(t):
    items = merge.clean_items(t.contact_items).where("verdict = 'valid'")
    return merge.merge_contacts(stored(t), items, JOBS_AS_OF).select(*SHOWN)


@query("ingest_contacts", f"""
WITH m AS ({MERGED}) SELECT query_id % 100 AS job, action, count(*) AS contacts, CAST(sum(items) AS BIGINT) AS items FROM m GROUP BY ALL""")
def _(t):
    merged = extract.ingest(stored(t), t.contact_items, JOBS_AS_OF)
    return merged.groupBy((F.col("query_id") % 100).alias("job"), "action").agg(F.count(F.lit(1)).alias("contacts"), F.sum("items").alias("items"))


@query("item_outcomes", f"""
WITH c AS (SELECT *, lower(m) AS email, {VERDICT} AS verdict FROM ({CLEAN})), k AS (SELECT email FROM ({BASE.format(customer='customer')}) WHERE deleted_at IS NULL),
r AS (SELECT item_id, verdict, email, row_number() OVER (PARTITION BY verdict, email ORDER BY seen_at, item_id) AS rn FROM c),
o AS (SELECT concat('spider', CAST(item_id % 4 AS VARCHAR)) AS spider, CASE WHEN verdict <> 'valid' THEN 'invalid' WHEN rn = 1 AND email NOT IN (SELECT email FROM k) THEN 'saved' ELSE 'duplicate' END AS outcome FROM r)
SELECT spider, count(*) AS items_processed, count(*) FILTER (WHERE outcome = 'saved') AS items_saved, count(*) FILTER (WHERE outcome = 'duplicate') AS items_duplicates,
  count(*) FILTER (WHERE outcome = 'invalid') AS items_invalid, round(count(*) FILTER (WHERE outcome = 'saved') / count(*) * 100, 4) AS success_rate FROM o GROUP BY 1""")
def _(t):
    classified = extract.classify_items(stored(t), t.contact_items)
    return reports.item_outcomes(classified.withColumn("spider", F.concat(F.lit("spider"), (F.col("item_id") % 4).cast("string"))))


@query("contacts_duplicates", f"""
WITH h AS (SELECT item_id AS id, {HASH} AS contact_hash FROM contact_items )
SELECT id, contact_hash, id = min(id) OVER w AS is_primary, CASE WHEN id <> min(id) OVER w THEN min(id) OVER w END AS duplicate_of,
  CASE WHEN id = min(id) OVER w THEN count(*) OVER w - 1 ELSE 0 END AS merge_count FROM h WINDOW w AS (PARTITION BY contact_hash)""")
def _(t):
    hashed = t.contact_items.select(F.col("item_id").alias("id"), contact.contact_hash("email", "name", "org").alias("contact_hash"))
    return jobs.link_duplicates(hashed)


# ------------------------------------------------------------------ jobs

FORMS = """SELECT page_id AS form_id, CASE page_id % 5 WHEN 0 THEN concat(' ', url, chr(10), chr(10), 'https://acme.org/', CAST(page_id AS STRING), ' ') WHEN 1 THEN 'not a url'
  WHEN 2 THEN concat(url, chr(10), 'bad') ELSE url END AS urls, CASE page_id % 7 WHEN 0 THEN ' ; ' ELSE 'lawyer, Expat;visa' END AS keywords FROM {pages}"""


@query("job_expand", f"""
WITH f AS (SELECT form_id, keywords, list_filter(list_transform(string_split(urls, chr(10)), lambda u: trim(u)), lambda u: u <> '') AS u FROM ({FORMS.format(pages='pages')})),
g AS (SELECT * FROM f WHERE len(list_filter(u, lambda x: NOT regexp_matches(x, {q(urls.FORM_URL)}))) = 0 AND keywords <> ' ; ' AND EXISTS (SELECT 1 FROM proxies WHERE active)),
l AS (SELECT form_id, unnest(generate_series(1, len(u))) AS i, u FROM g)
SELECT form_id, CAST(i - 1 AS INTEGER) AS line, u[i] AS url, c.country_filter, '["lawyer","Expat","visa"]' AS custom_keywords, 'pending' AS status, {JT} AS created_at, 'fr' AS lang_filter
FROM l, (SELECT unnest(['FRANCE', 'ITALY']) AS country_filter) c""")
def _(t):
    forms = t.spark.sql(FORMS, pages=t.scan("pages"))
    return jobs.expand_jobs(forms, ["FRANCE", "ITALY"], t.proxies, JOBS_AS_OF, "fr")


STARTS = "SELECT id, updated_at AS started_at FROM {queue} WHERE id % 4 > 0"
STUCK_AT = "1998-06-01 00:00:00"


@query("jobs_stuck", f"""
SELECT id, url FROM queue WHERE status = 'in_progress' AND id % 4 > 0 AND epoch_us(TIMESTAMP '{STUCK_AT}') - epoch_us(updated_at) > 3600000000""")
def _(t):
    return jobs.stuck_jobs(t.queue, t.spark.sql(STARTS, queue=t.queue), STUCK_AT).select("id", "url")


@query("job_expire", f"""
WITH h AS (SELECT *, status = 'in_progress' AND id % 4 > 0 AND epoch_us(TIMESTAMP '{STUCK_AT}') - epoch_us(updated_at) > 3600000000 AS hit FROM queue )
SELECT id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN {q(jobs.EXPIRED)} ELSE last_error END AS last_error,
  CASE WHEN hit THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN hit THEN TIMESTAMP '{STUCK_AT}' + INTERVAL '30' MINUTE ELSE next_retry_at END AS next_retry_at FROM h""")
def _(t):
    starts = t.spark.sql(STARTS, queue=t.queue)
    return jobs.expire(t.queue, starts, STUCK_AT).select("id", "status", "last_error", "retry_count", "next_retry_at")


@query("jobs_stop_all", f"""
SELECT id, CASE WHEN status = 'in_progress' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'in_progress' THEN {q(jobs.STOPPED)} ELSE last_error END AS last_error,
  CASE WHEN status = 'in_progress' THEN {JT} ELSE updated_at END AS updated_at FROM queue """)
def _(t):
    return jobs.stop_all(t.queue, JOBS_AS_OF).select("id", "status", "last_error", "updated_at")


OUTCOMES = """SELECT id, id % 3 = 0 AS success, last_error AS error, CAST(id % 500 AS INT) AS seconds, CAST(id % 9 AS INT) AS contacts FROM {queue} WHERE status = 'in_progress'"""


def sql_transition(counted: str) -> str:
    return f"""
WITH r AS (SELECT *, status = 'in_progress' AS ran, status = 'in_progress' AND id % 3 = 0 AS ok, status = 'in_progress' AND id % 3 <> 0 AS bad,
  retry_count < max_retries AND NOT contains(lower(last_error), 'timeout') AS again FROM queue )
SELECT id, CASE WHEN ok THEN 'done' WHEN bad AND again THEN 'pending' WHEN bad THEN 'failed' ELSE status END AS status, last_error,
  CASE WHEN ran THEN CAST(id % 500 AS INTEGER) END AS execution_time_seconds, CASE WHEN ok THEN CAST(id % 9 AS INTEGER) ELSE contacts_extracted END AS contacts_extracted,
  CASE WHEN {counted} THEN retry_count + 1 ELSE retry_count END AS retry_count,
  CASE WHEN {counted} THEN {JT} + INTERVAL '30' MINUTE ELSE next_retry_at END AS next_retry_at, CASE WHEN ran THEN {JT} ELSE updated_at END AS updated_at FROM r"""


TRANSITION_COLUMNS = [
    "id", "status", "last_error", "execution_time_seconds", "contacts_extracted", "retry_count", "next_retry_at", "updated_at",
]


@query("job_transition", sql_transition("bad"))
def _(t):
    return jobs.transition(t.queue, t.spark.sql(OUTCOMES, queue=t.queue), JOBS_AS_OF).select(*TRANSITION_COLUMNS)


@query("job_transition_as_written", sql_transition("bad AND NOT again"))
def _(t):
    outcomes = t.spark.sql(OUTCOMES, queue=t.queue)
    return jobs.transition(t.queue, outcomes, JOBS_AS_OF, as_written=True).select(*TRANSITION_COLUMNS)


@query("session_expire", f"""
WITH h AS (SELECT *, coalesce(active AND deleted_at IS NULL AND expires_at < {NT}, FALSE) AS hit FROM sessions )
SELECT id, CASE WHEN hit THEN FALSE ELSE active END AS active, CASE WHEN hit THEN coalesce(notes, '') || ' [auto-disabled: expired]' ELSE notes END AS notes,
  CASE WHEN hit THEN {NT} ELSE updated_at END AS updated_at FROM h""")
def _(t):
    return jobs.expire_sessions(t.sessions, AS_OF).select("id", "active", "notes", "updated_at")


def sql_touch(table: str, counter: str, uses: str) -> str:
    return f"""
WITH u AS ({uses})
SELECT s.id, CAST(coalesce(s.{counter}, 0) + coalesce(u.n, 0) AS BIGINT) AS {counter}, CASE WHEN u.n IS NOT NULL THEN {NT} ELSE s.last_used_at END AS last_used_at FROM {table} s LEFT JOIN u ON u.id = s.id"""


@query("proxy_touch", sql_touch("proxies", "total_requests", "SELECT proxy_id AS id, count(*) AS n FROM proxy_results GROUP BY 1"))
def _(t):
    uses = t.proxy_results.select(F.col("proxy_id").alias("id"))
    return proxies.touch(t.proxies, uses, "total_requests", AS_OF).select("id", "total_requests", "last_used_at")


@query("session_touch", sql_touch("sessions", "usage_count", "SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1"))
def _(t):
    uses = t.events.select(F.col("user_id").alias("id"))
    return proxies.touch(t.sessions, uses, "usage_count", AS_OF).select("id", "usage_count", "last_used_at")


@query("stamp_updated", f"""
WITH h AS (SELECT *, coalesce(active AND deleted_at IS NULL AND expires_at < {NT}, FALSE) AS hit FROM sessions )
SELECT id, active AND NOT hit AS active, CASE WHEN hit THEN {NT} ELSE created_at END AS updated_at FROM h""")
def _(t):
    from crawlops.operators.merge import stamp_updated

    after = jobs.expire_sessions(t.sessions, AS_OF).select("id", F.col("active").alias("new_active"))
    both = t.sessions.withColumn("updated_at", F.col("created_at")).join(after, "id")
    return stamp_updated(both, {"active": "new_active"}, AS_OF).select("id", "active", "updated_at")


# ------------------------------------------------------------------ proxies

RUN = """WITH s AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY proxy_id ORDER BY ts, event_id) AS island FROM proxy_results ),
r AS (SELECT *, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY proxy_id, island ORDER BY ts, event_id) AS BIGINT) AS failure_run FROM s)"""


@query("proxy_failure_runs", f"{RUN} SELECT event_id, proxy_id, failure_run FROM r")
def _(t):
    return proxies.failure_runs(t.proxy_results).select("event_id", "proxy_id", "failure_run")


# pool with a stored run of failures, small limits so that cooldowns occur
@query("proxy_state_after", f"""{RUN},
p AS (SELECT r.*, p.consecutive_failures AS old, island = 0 AS lead_run FROM r JOIN proxies p ON p.id = r.proxy_id),
b AS (SELECT *, CASE WHEN success THEN 0 ELSE failure_run - 1 + CASE WHEN lead_run THEN old ELSE 0 END END AS before_run,
  row_number() OVER (PARTITION BY proxy_id ORDER BY ts DESC, event_id DESC) AS back FROM p),
a AS (SELECT proxy_id, count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE NOT success) AS bad, max(ts) FILTER (WHERE success) AS last_ok,
  max(ts) FILTER (WHERE NOT success) AS last_bad, max(ts) FILTER (WHERE NOT success AND before_run >= 2) AS cool,
  max(CASE WHEN back = 1 AND success THEN 1 ELSE 0 END) AS was_ok, max(CASE WHEN back = 1 THEN CASE WHEN success THEN 0 ELSE before_run + 1 END END) AS run,
  last(response_time_ms ORDER BY ts, event_id) FILTER (WHERE success AND response_time_ms IS NOT NULL) AS ms FROM b GROUP BY 1)
SELECT p.id, p.successful_requests + coalesce(a.ok, 0) AS successful_requests, p.failed_requests + coalesce(a.bad, 0) AS failed_requests,
  CAST(coalesce(a.run, p.consecutive_failures) AS BIGINT) AS consecutive_failures,
  CASE WHEN a.run IS NULL THEN p.success_rate WHEN p.total_requests > 0 THEN round((p.successful_requests + a.ok - a.was_ok) / p.total_requests, 6)
    WHEN a.was_ok = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS success_rate,
  coalesce(a.ms, p.response_time_ms) AS response_time_ms, coalesce(a.cool + INTERVAL '300' SECOND, p.cooldown_until) AS cooldown_until,
  coalesce(a.last_ok, p.last_success_at) AS last_success_at, coalesce(a.last_bad, p.last_failure_at) AS last_failure_at FROM proxies p LEFT JOIN a ON a.proxy_id = p.id""")
def _(t):
    return proxies.apply_results(t.proxies, t.proxy_results, max_failures=2).select(
        "id", "successful_requests", "failed_requests", "consecutive_failures", "success_rate", "response_time_ms",
        "cooldown_until", "last_success_at", "last_failure_at",
    )


@query("proxy_probe_update", """
WITH a AS (SELECT proxy_id, count(*) FILTER (WHERE success) AS ok, avg(response_time_ms::DOUBLE) FILTER (WHERE success) AS ms FROM proxy_results WHERE proxy_id % 3 > 0 GROUP BY 1)
SELECT p.id, coalesce(round(a.ms, 3), p.response_time_ms::DOUBLE) AS response_time_ms, coalesce(a.ok / 5.0::DOUBLE, p.success_rate) AS success_rate
FROM proxies p LEFT JOIN a ON a.proxy_id = p.id AND a.ok > 0""")
def _(t):
    return proxies.probe_update(t.proxies, t.proxy_results.where("proxy_id % 3 > 0")).select("id", "response_time_ms", "success_rate")


IDX = f"x AS (SELECT id AS proxy, label, host, row_number() OVER (ORDER BY {FULL_ORDER}) - 1 AS i FROM proxies WHERE {ELIGIBLE})"


def sql_draw(*parts: str, seed: int = 0) -> str:
    cols = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {cols})), 1, 8) AS BIGINT)"


def requests(t):
    return t.proxy_results.select("event_id", "ts", "job_id")


@query("assign_round_robin", f"""
WITH {IDX}, r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS turn FROM proxy_results )
SELECT r.event_id, x.proxy FROM r JOIN x ON x.i = r.turn % (SELECT count(*) FROM x)""")
def _(t):
    pool = proxies.indexed_proxies(t.proxies, AS_OF)
    return proxies.assign_round_robin(requests(t), pool, ["ts", "event_id"]).select("event_id", "proxy")


@query("assign_random", f"""
WITH {IDX}, r AS (SELECT event_id, {sql_draw('event_id', seed=7)} AS d FROM proxy_results )
SELECT r.event_id, x.proxy FROM r JOIN x ON x.i = r.d % (SELECT count(*) FROM x)""")
def _(t):
    return proxies.assign_random(requests(t), proxies.indexed_proxies(t.proxies, AS_OF), "event_id", seed=7).select("event_id", "proxy")


@query("assign_weighted", f"""
WITH {IDX}, w AS (SELECT *, CASE WHEN label = 'pool-a' THEN 4.0::DOUBLE WHEN host = '10.0.0.3' THEN 20.0::DOUBLE WHEN host = '10.0.0.5' THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS w FROM x),
c AS (SELECT *, sum(w) OVER (ORDER BY i) AS hi FROM w), r AS (SELECT event_id, {sql_draw('event_id', seed=3)} / 4294967296.0::DOUBLE * (SELECT max(hi) FROM c) AS u FROM proxy_results )
SELECT r.event_id, c.proxy FROM r JOIN c ON c.hi - c.w <= r.u AND r.u < c.hi""")
def _(t):
    weights = {"default": 1.5, "10.0.0.3": 20.0, "10.0.0.5": 0.0, "pool-a": 4.0}
    pool = proxies.indexed_proxies(t.proxies, AS_OF)
    return proxies.assign_weighted(requests(t), pool, "event_id", weights, seed=3).select("event_id", "proxy")


@query("assign_best", f"""
SELECT event_id, (SELECT id FROM proxies WHERE {SIMPLE} ORDER BY coalesce(success_rate, 0.5) DESC, coalesce(response_time_ms, 1000), {SIMPLE_ORDER} LIMIT 1) AS proxy FROM proxy_results """)
def _(t):
    return proxies.assign_best(requests(t), t.proxies, AS_OF).select("event_id", "proxy")


@query("assign_first", f"SELECT event_id, (SELECT id FROM proxies WHERE {SIMPLE} ORDER BY {SIMPLE_ORDER} LIMIT 1) AS proxy FROM proxy_results ")
def _(t):
    return proxies.assign_first(requests(t), t.proxies, AS_OF).select("event_id", "proxy")


# greedy blocks: follow every job's starts one after the other
BLOCKS = """n AS (SELECT DISTINCT job_id, epoch_us(ts) AS us FROM proxy_results ),
b AS (SELECT job_id, min(us) AS us FROM n GROUP BY 1 UNION ALL
  SELECT b.job_id, (SELECT min(n.us) FROM n WHERE n.job_id = b.job_id AND n.us >= b.us + {span}) FROM b WHERE b.us IS NOT NULL)"""


@query("assign_sticky", f"""
WITH RECURSIVE {BLOCKS.format(span=86400 * 1000000)}, {IDX},
r AS (SELECT p.event_id, p.job_id, (SELECT max(b.us) FROM b WHERE b.job_id = p.job_id AND b.us <= epoch_us(p.ts)) AS s FROM proxy_results p)
SELECT r.event_id, r.s AS block_us, x.proxy FROM r JOIN x ON x.i = {sql_draw('r.job_id', 'r.s', seed=1)} % (SELECT count(*) FROM x)""")
def _(t):
    pool = proxies.indexed_proxies(t.proxies, AS_OF)
    return proxies.assign_sticky(requests(t), pool, ttl=86_400, seed=1).select("event_id", "block_us", "proxy")


# ------------------------------------------------------------------ crawl and extraction

ANCHORS = "unnest(regexp_extract_all(html, {p}, 1)) AS href, unnest(regexp_extract_all(html, {p}, 2)) AS label, unnest(generate_series(0, len(regexp_extract_all(html, {p})) - 1)) AS pos"
LINKS = f"""a AS (SELECT page_id, url AS base, {ANCHORS.format(p=q(frontier.ANCHOR))} FROM pages),
j AS (SELECT page_id, base, pos, {sql_join('base', 'href')} AS url, CASE WHEN contains(href, 'contact') THEN 1 WHEN contains(href, 'about') THEN 2 WHEN contains(href, 'team') THEN 3
  WHEN contains(href, 'staff') THEN 4 WHEN contains(label, 'Contact') THEN 5 WHEN contains(label, 'About') THEN 6 ELSE 7 END AS rank FROM a),
l AS (SELECT page_id, url, min({{'rank': rank, 'pos': pos}}) AS p FROM j WHERE {DOMAIN.format('url')} = {DOMAIN.format('base')}
  AND NOT regexp_matches(lower(url), '(\\.pdf|\\.doc|\\.docx|\\.jpg|\\.png|\\.gif|\\.zip)$')
  AND NOT (contains(lower(url), 'javascript:') OR contains(lower(url), 'mailto:') OR contains(lower(url), 'tel:') OR contains(url, '#')) GROUP BY 1, 2)"""


@query("frontier_links", f"""
WITH {LINKS}, n AS (SELECT page_id, url, p.rank AS rank, p.pos AS pos FROM l WHERE url NOT IN (SELECT url FROM l WHERE page_id % 2 = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, pos) AS link_number FROM n)
SELECT page_id, url, rank, CAST(pos AS INTEGER) AS pos, CAST(link_number AS INTEGER) AS link_number FROM r WHERE link_number <= 5""")
def _(t):
    seen = frontier.page_links(t.pages.where("page_id % 2 = 0")).select("url")
    return frontier.frontier(t.pages, seen).select("page_id", "url", "rank", "pos", "link_number")


@query("page_cap", f"""
WITH v AS (SELECT page_id, {DOMAIN.format('url')} AS netloc FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY netloc ORDER BY page_id) AS n FROM v)
SELECT page_id, netloc, CAST(n AS INTEGER) AS visit_number FROM r WHERE n <= 3""")
def _(t):
    return jobs.cap_pages(t.pages.select("page_id", urls.url_domain("url").alias("netloc")), "netloc", ["page_id"], 3)


# jobs whose start URLs are the given pages, with keywords by page number
SEED_JOBS = """SELECT page_id AS id, url, CASE page_id % 3 WHEN 0 THEN '["Contact", "the "]' WHEN 1 THEN 'Consulting, tion; le' ELSE 'zzz' END AS custom_keywords,
  CASE page_id % 2 WHEN 0 THEN 'any' ELSE 'multiple' END AS match_mode, 2 AS min_matches, CASE page_id % 5 WHEN 0 THEN NULL ELSE 'FRANCE' END AS country_filter FROM {pages}"""
CAP = 5  # of the capped variant


def seed_jobs(t):
    return t.spark.sql(SEED_JOBS, pages=t.scan("pages"))


def corpus_pages(t):
    return t.corpus.select(F.col("doc_id").alias("page_id"), "url", "text")


def sql_job_pages(cap: str = "") -> str:
    return f"""jobs AS ({SEED_JOBS.format(pages='pages')}), cp AS (SELECT doc_id AS page_id, url, text, {DOMAIN.format('url')} AS netloc FROM corpus ),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY netloc ORDER BY page_id) AS n FROM cp) WHERE netloc <> '' {cap}),
jp AS (SELECT j.id AS query_id, j.url AS seed_url, j.custom_keywords, j.match_mode, j.country_filter, t.page_id, t.url, t.text FROM jobs j JOIN top t ON t.netloc = {DOMAIN.format('j.url')})"""


JOB_PAGES = sql_job_pages()


@query("job_pages", f"WITH {JOB_PAGES} SELECT query_id, page_id, seed_url, match_mode FROM jp")
def _(t):
    return jobs.job_pages(seed_jobs(t), corpus_pages(t)).select("query_id", "page_id", "seed_url", "match_mode")


@query("job_pages_capped", f"WITH {sql_job_pages(f'AND n <= {CAP}')} SELECT query_id, page_id, seed_url, match_mode FROM jp")
def _(t):
    return jobs.job_pages(seed_jobs(t), corpus_pages(t), CAP).select("query_id", "page_id", "seed_url", "match_mode")


def sql_extract(job_pages: str) -> str:
    return f"""
WITH {job_pages},
kw AS (SELECT *, lower(text) AS t, CASE query_id % 3 WHEN 0 THEN ['contact', 'the'] WHEN 1 THEN ['consulting', 'tion', 'le'] ELSE ['zzz'] END AS w FROM jp),
gate AS (SELECT *, list_filter(w, lambda x: contains(t, x)) AS found FROM kw),
ok AS (SELECT * FROM gate WHERE CASE match_mode WHEN 'any' THEN len(found) >= 1 ELSE len(found) >= 2 END),
ph AS (SELECT doc_id, a AS phones FROM {PHONES}),
m AS (SELECT *, regexp_extract_all(text, {q(contact.EMAIL_IN_PAGE)}) AS all_mails FROM ok),
e AS (SELECT *, list_filter(all_mails, lambda x, i: list_position(all_mails, x) = i) AS mails FROM m),
u AS (SELECT *, unnest(mails) AS email, unnest(generate_series(0, len(mails) - 1)) AS place FROM e),
c AS (SELECT u.*, {sql_around(200)} AS c, {sql_around(300)} AS c300, ph.phones, lower(list_last(string_split(email, '@'))) AS md, lower({DOMAIN.format('seed_url')}) AS sd FROM u JOIN ph ON ph.doc_id = u.page_id)
SELECT query_id, page_id, CAST(place AS INTEGER) AS place, email, {SPIDER_SQL} AS page_lang, {SQL_NAME} AS name, {SQL_ORG} AS org,
  list_filter(phones, lambda x: contains(c300, x))[1] AS phone, country_filter AS country, array_to_string(found, ',') AS found_keywords,
  round(least(1.0::DOUBLE, 0.5::DOUBLE + len(found)::DOUBLE / len(w) * 0.3::DOUBLE + CASE WHEN contains(sd, md) OR contains(md, sd) THEN 0.2::DOUBLE ELSE 0::DOUBLE END), 6) AS confidence_score,
  md5(substring(text, 1, 1000)) AS raw_md5 FROM c"""


EXTRACT = sql_extract(JOB_PAGES)


def extracted(t):
    shown = {"confidence_score": F.round("confidence_score", 6), "raw_md5": F.md5("raw_text")}
    return extract.extract_contacts(seed_jobs(t), corpus_pages(t), derived=shown)


@query("extract_contacts", EXTRACT)
def _(t):
    return extracted(t).select(
        "query_id", "page_id", "place", "email", "page_lang", "name", "org", "phone", "country", "found_keywords",
        "confidence_score", "raw_md5",
    )


@query("pages_to_contacts", f"""
WITH x AS ({EXTRACT}), v AS (SELECT lower(email) AS email, {sql_field('name', 255)} AS name, {sql_field('org', 200)} AS org, {sql_field('phone', 30)} AS phone, country, query_id, page_id, place,
  TIMESTAMP '2024-01-01 00:00:00' + CAST(query_id AS INTEGER) * INTERVAL '1' SECOND AS seen_at, page_id * 100 + place AS item_id, confidence_score
  FROM x WHERE regexp_matches(email, {q(EV)}) AND NOT regexp_matches(lower(email), {q(ES)}))
SELECT email, first(name ORDER BY length(name) DESC, seen_at, item_id) AS name, last(org ORDER BY seen_at, item_id) FILTER (WHERE org IS NOT NULL) AS org,
  last(phone ORDER BY seen_at, item_id) FILTER (WHERE phone IS NOT NULL) AS phone, last(country ORDER BY seen_at, item_id) FILTER (WHERE country IS NOT NULL) AS country,
  last(query_id ORDER BY seen_at, item_id) AS query_id, max(confidence_score) AS confidence_score, count(*) AS items FROM v WHERE name IS NOT NULL GROUP BY 1""")
def pages_to_contacts(t):
    """From pages and jobs to one merged contact per address, by classes of jobs."""
    classes = jobs.job_classes(seed_jobs(t))
    seen_at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("query_id"))
    members = classes.select("class_id", "query_id", "seed_url", F.col("country_filter").alias("country"), seen_at.alias("seen_at"))
    found = extract.class_items(extract.class_contacts(classes, corpus_pages(t)), members)
    items = found.withColumns({"item_id": F.col("page_id") * 100 + F.col("place"), "confidence_score": F.round("confidence_score", 6)})
    valid = merge.clean_items(items).where("verdict = 'valid'")
    return merge.fold_items(valid).select("email", "name", "org", "phone", "country", "query_id", "confidence_score", "items")


CLASS_OF = f"min(id) OVER (PARTITION BY {DOMAIN.format('url')}, id % 3, match_mode)"


@query("job_classes", f"""
SELECT id AS query_id, {CLASS_OF} AS class_id, count(*) OVER (PARTITION BY {DOMAIN.format('url')}, id % 3, match_mode) AS jobs_in_class
FROM ({SEED_JOBS.format(pages='pages')}) WHERE {DOMAIN.format('url')} <> ''""")
def _(t):
    classes = jobs.job_classes(seed_jobs(t))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("jobs_in_class"))
    return classes.join(sizes, "class_id").select("query_id", "class_id", "jobs_in_class")


FIRST_JOBS = JOB_PAGES.replace("jobs AS (", "every AS (", 1).replace("cp AS (", f"jobs AS (SELECT * FROM (SELECT *, {CLASS_OF} AS class_id FROM every) WHERE id = class_id), cp AS (", 1)


@query("extract_classes", f"""
SELECT query_id AS class_id, page_id, place, email, page_lang, name, org, phone, found_keywords, confidence_score, raw_md5 FROM ({sql_extract(FIRST_JOBS)})""")
def _(t):
    return extract.class_contacts(jobs.job_classes(seed_jobs(t)), corpus_pages(t)).select(
        "class_id", "page_id", "place", "email", "page_lang", "name", "org", "phone", "found_keywords",
        F.round("confidence_score", 6).alias("confidence_score"), F.md5("raw_text").alias("raw_md5"),
    )


EDGES = "SELECT page_id AS src, (page_id * 7 + k * 13) % (SELECT count(*) FROM {pages}) AS dst, CAST(k AS INT) AS rank FROM {pages} LATERAL VIEW explode(array(0, 1, 2, 3, 4, 5, 6)) v AS k"


MOST, PER_PAGE = 25, 5
EDGES_SQL = EDGES.format(pages="pages").replace("LATERAL VIEW explode(array(0, 1, 2, 3, 4, 5, 6)) v AS k", ", (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k)")
# one row per job and level: what was visited, the pages of the level, all depths
CRAWL = f"""
WITH RECURSIVE e AS (SELECT src, dst, min(rank) AS rank FROM ({EDGES_SQL}) GROUP BY 1, 2),
a AS (SELECT src, list(dst ORDER BY rank, dst) AS nodes FROM e GROUP BY 1), g AS (SELECT map_from_entries(list((src, nodes))) AS m FROM a),
s AS (SELECT page_id AS job_id, [page_id] AS seen, [page_id] AS level, [CAST(0 AS INTEGER)] AS depths, CAST(0 AS INTEGER) AS depth FROM pages
  UNION ALL SELECT job_id, list_concat(seen, fresh), fresh, list_concat(depths, [CAST(depth + 1 AS INTEGER) FOR x IN fresh]), CAST(depth + 1 AS INTEGER) FROM (
    SELECT s.*, list_reduce(list_prepend(CAST([] AS BIGINT[]), [list_filter(g.m[p], lambda y: NOT list_contains(seen, y)) FOR p IN level]),
      lambda done, more: list_concat(done, list_filter(more, lambda y: NOT list_contains(done, y))[1:{PER_PAGE}]))[1:{MOST} - len(seen)] AS fresh FROM s, g) WHERE len(fresh) > 0),
l AS (SELECT job_id, arg_max(seen, depth) AS seen, arg_max(depths, depth) AS depths FROM s GROUP BY 1)
SELECT job_id, unnest(seen) AS node, CAST(unnest(generate_series(1, len(seen))) AS INTEGER) AS visit_number, unnest(depths) AS depth FROM l"""


@query("crawl_expand", CRAWL)
def _(t):
    edges = t.spark.sql(EDGES, pages=t.scan("pages"))
    seeds = t.pages.select(F.col("page_id").alias("job_id"), F.col("page_id").alias("node"))
    return frontier.crawl_expand(seeds, edges, max_pages=MOST, links_per_page=PER_PAGE)
