"""Streams over the given files, checked against SQL over the whole tables."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from crawlops.catalog import alerts as judged
from crawlops.catalog.alerts import GRID, HELD, INHIBITED, STEP, sql_steps
from crawlops.catalog.functions import sql_normalize
from crawlops.catalog.joins import BLOCKS, IDX, MERGED, SCOPE, sql_draw, stored
from crawlops.catalog.registry import query
from crawlops.catalog.reports import BY_COUNTRY, HOURLY
from crawlops.fixtures import AS_OF, JOBS_AS_OF, SQL
from crawlops.functions.urls import url_domain
from crawlops.operators import proxies
from crawlops.plans.alerts import RULES, inhibit
from crawlops.schemas import EVENTS
from crawlops.session import at
from crawlops.sources import sinks
from crawlops.streaming import jobs as streams


def files(t, table: str) -> str:
    """Glob that fits a table stored as one file as well as a folder of files."""
    return f"{t.sf_dir}/{table}.parque[t]"


def events(t):
    return streams.stream_events(t.spark, files(t, "events"), EVENTS)


def projected(t, name: str):
    """A projection of the event stream."""
    return t.spark.sql(SQL[name], events=events(t))


def back(df, *names: str):
    """Times without zone, as in the stored tables."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@contextlib.contextmanager
def state_store(spark):
    """RocksDB state while a query with per-key state runs."""
    before = spark.conf.get(streams.PROVIDER)
    spark.conf.set(streams.PROVIDER, streams.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(streams.PROVIDER, before)


@query("stream_source", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(t):
    out = streams.run_available(events(t), "source")
    return back(out, "ts").select("event_id", "ts", "user_id", "event_type", "value")


@query("stream_seen", f"SELECT DISTINCT {SCOPE} AS scope, {sql_normalize('url')} AS normalized_url FROM proxy_results ")
def _(t):
    with state_store(t.spark):
        return streams.run_available(streams.stream_unseen(projected(t, "proxy_results")), "seen").select("scope", "normalized_url")


# windows that end after this are still open when the stream has read everything
CLOSED = "(SELECT max(ts) - INTERVAL '10' MINUTE FROM events)"


@query("stream_rates", f"""
WITH w AS (SELECT unnest([time_bucket(INTERVAL '1' HOUR, ts), time_bucket(INTERVAL '1' HOUR, ts) - INTERVAL '1' HOUR]) AS window_start, status, event_type, country_key FROM metrics )
SELECT window_start, window_start + INTERVAL '2' HOUR AS window_end, status, event_type, country_key, count(*) AS n, round(count(*) / 7200.0::DOUBLE, 9) AS rate
FROM w WHERE window_start + INTERVAL '2' HOUR <= {CLOSED} GROUP BY ALL""")
def _(t):
    rates = streams.stream_rates(projected(t, "metrics"), ["status", "event_type", "country_key"], "2 hours", "1 hour")
    return back(streams.run_available(rates, "rates"), "window_start", "window_end")


@query("stream_proxy_hourly", f"""
SELECT proxy_id, ts::DATE AS date, CAST(hour(ts) AS INTEGER) AS hour, {HOURLY} FROM proxy_results
WHERE time_bucket(INTERVAL '1' HOUR, ts) + INTERVAL '1' HOUR <= {CLOSED} GROUP BY 1, 2, 3""")
def _(t):
    return streams.run_available(streams.stream_proxy_hourly(projected(t, "proxy_results")), "hourly")


@query("stream_counters", "SELECT event_type AS name, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1")
def _(t):
    return streams.stream_counters(events(t), "event_type", F.col("user_id"))


DAY = 86_400


@query("stream_breaker", f"""
WITH g AS (SELECT *, max(CASE WHEN NOT success THEN epoch_us(ts) END) OVER (PARTITION BY proxy_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf FROM proxy_results ),
i AS (SELECT *, sum(CASE WHEN success OR epoch_us(ts) - lf >= {4 * DAY}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY proxy_id ORDER BY ts, event_id) AS island FROM g),
f AS (SELECT *, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY proxy_id, island ORDER BY ts, event_id) AS BIGINT) AS failures FROM i),
o AS (SELECT *, CASE WHEN NOT success AND failures >= 2 THEN epoch_us(ts) + {4 * DAY}000000 END AS opens FROM f)
SELECT event_id, proxy_id, failures, coalesce(max(opens) OVER (PARTITION BY proxy_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= epoch_us(ts) AS allowed,
  max(opens) OVER (PARTITION BY proxy_id ORDER BY ts, event_id) AS open_until_us FROM o""")
def _(t):
    with state_store(t.spark):
        return streams.run_available(streams.stream_breaker(projected(t, "proxy_results"), 2, 4 * DAY), "breaker")


@query("stream_sticky", f"""
WITH RECURSIVE {BLOCKS.format(span=DAY * 1000000)}, {IDX},
r AS (SELECT p.event_id, p.job_id, (SELECT max(b.us) FROM b WHERE b.job_id = p.job_id AND b.us <= epoch_us(p.ts)) AS s FROM proxy_results p)
SELECT r.event_id, r.s AS block_us, x.proxy FROM r JOIN x ON x.i = {sql_draw('r.job_id', 'r.s', seed=1)} % (SELECT count(*) FROM x)""")
def _(t):
    pool = proxies.indexed_proxies(t.proxies, AS_OF)
    with state_store(t.spark):
        return streams.run_available(streams.stream_sticky(projected(t, "proxy_results"), pool, DAY, 1), "sticky")


@query("stream_heartbeat", f"""
WITH b AS (SELECT user_id AS worker, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT worker, ts AS last_beat, ts + INTERVAL '{DAY}' SECOND AS silent_at FROM b
WHERE nxt - ts > INTERVAL '{DAY}' SECOND OR (nxt IS NULL AND ts + INTERVAL '{DAY}' SECOND < (SELECT max(ts) - INTERVAL '1' MINUTE FROM events))""")
def _(t):
    beats = events(t).select("event_id", F.col("user_id").alias("worker"), "ts")
    with state_store(t.spark):
        return back(streams.run_available(streams.stream_heartbeat(beats, DAY), "heartbeat"), "last_beat", "silent_at")


GAUGES = [r for r in RULES if r.kind in streams.SAMPLE_KINDS]
PUBLIC = "AND NOT regexp_matches(instance, '^(192\\.168\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|127\\.)')"
GAUGE_ROWS = " UNION ALL ".join(
    f"""SELECT '{r.name}' AS alert, event_id, instance, ts, {'epoch_us(ts) // 1000000 - value' if r.kind == 'age' else 'value'} {r.op} {float(r.threshold)}::DOUBLE AS cond, {r.hold} AS hold
  FROM samples WHERE metric = '{r.metrics[0]}' {PUBLIC if r.kind == 'last_public' else ''}""" for r in GAUGES
)


@query("stream_alerts", f"""
WITH m AS ({GAUGE_ROWS}), c AS (SELECT *, lag(cond) OVER (PARTITION BY alert, instance ORDER BY ts, event_id) AS b4 FROM m),
s AS (SELECT *, max(CASE WHEN cond AND NOT coalesce(b4, FALSE) THEN ts END) OVER (PARTITION BY alert, instance ORDER BY ts, event_id) AS active_since FROM c)
SELECT alert, instance, event_id, ts, active_since, CASE WHEN epoch_us(ts) - epoch_us(active_since) >= hold * 1000000 THEN 'firing' ELSE 'pending' END AS state FROM s WHERE cond""")
def _(t):
    with state_store(t.spark):
        return back(streams.run_available(streams.stream_alerts(projected(t, "samples"), GAUGES), "alerts"), "ts", "active_since")


@query("stream_rules", f"""
WITH {sql_steps(STEP)}, {GRID}, {HELD}, closed AS ({INHIBITED}) SELECT * FROM closed WHERE ts < (SELECT max(ts) - INTERVAL '10' MINUTE FROM events)""")
def _(t):
    with state_store(t.spark):
        held = back(streams.run_available(streams.stream_rules(projected(t, "samples"), STEP, judged.RULES), "rules"), "ts", "active_since")
    return inhibit(held)


@query("stream_rate_limit", f"""
WITH c AS (SELECT proxy_id, time_bucket(INTERVAL '1' DAY, ts) AS window_start, count(*) AS n FROM proxy_results
  WHERE time_bucket(INTERVAL '1' DAY, ts) + INTERVAL '1' DAY <= {CLOSED} GROUP BY 1, 2)
SELECT c.proxy_id, c.window_start, c.n, p.priority / {DAY}.0::DOUBLE AS rps_max FROM c JOIN proxies p ON p.id = c.proxy_id WHERE c.n > p.priority""")
def _(t):
    limits = t.proxies.select(F.col("id").alias("proxy_id"), (F.col("priority") / F.lit(float(DAY))).alias("rps_max"))
    found = streams.rate_violations(projected(t, "proxy_results"), limits, DAY)
    return back(streams.run_available(found, "limits"), "window_start")


@query("stream_rate_limit_domain", f"""
WITH c AS (SELECT split_part(url, '/', 3) AS domain, time_bucket(INTERVAL '1' DAY, ts) AS window_start, count(*) AS n FROM proxy_results
  WHERE time_bucket(INTERVAL '1' DAY, ts) + INTERVAL '1' DAY <= {CLOSED} GROUP BY 1, 2),
l AS (SELECT domain, window_start, n, CASE domain WHEN 'site1.acme.org' THEN 0.00001::DOUBLE WHEN 'site2.acme.org' THEN 1.0::DOUBLE ELSE 0.00005::DOUBLE END AS rps_max FROM c)
SELECT * FROM l WHERE n > rps_max * {DAY}""")
def _(t):
    requests = projected(t, "proxy_results").withColumn("domain", url_domain("url"))
    limits = t.spark.createDataFrame([("site1.acme.org", 0.00001), ("site2.acme.org", 1.0)], "domain string, rps_max double")
    found = streams.rate_violations(requests, limits, DAY, key="domain", default=0.00005)
    return back(streams.run_available(found, "domains"), "window_start")


@query("stream_contacts", f"SELECT email, name, org, phone, country, url, query_id, deleted_at FROM ({MERGED})")
def _(t):
    orders = t.spark.readStream.schema(t.orders.schema).parquet(files(t, "orders"))
    items = t.spark.sql(SQL["contact_items"], orders=orders, customer=t.customer, nation=t.nation)
    merged = streams.stream_ingest(items, stored(t), JOBS_AS_OF)
    return merged.select("email", "name", "org", "phone", "country", "url", "query_id", "deleted_at")


@query("stream_mv", BY_COUNTRY)
def _(t):
    customers = t.spark.readStream.schema(t.customer.schema).parquet(files(t, "customer"))
    contacts = t.spark.sql(SQL["contacts"], customer=customers, nation=t.nation)
    since = F.to_date(at(AS_OF)).cast("timestamp_ntz") - F.expr("INTERVAL '7' DAY")
    return sinks.read_snapshot(t.spark, streams.stream_refresh(contacts, AS_OF, since))
