"""Merges and transitions on the declared tables: same columns out as in, untouched rows unchanged."""

import datetime

import pytest
from pyspark.sql import functions as F

from crawlops import schemas
from crawlops.operators import jobs, merge, proxies

AS_OF = "2024-01-31 00:00:00"
DAY = datetime.datetime(2024, 1, 10)


def stored(spark, table, n=6, **given):
    """Rows with a value in every column; ``given`` holds functions of the row number."""
    empty = spark.createDataFrame([], schemas.TABLES[table])
    made = []
    for i in range(1, n + 1):
        row = {}
        for field in empty.schema:
            kind = field.dataType.simpleString()
            row[field.name] = {
                "string": f"{field.name}{i}", "int": i, "bigint": i, "double": i / 10, "boolean": i % 2 == 0, "timestamp_ntz": DAY + datetime.timedelta(i),
                "array<string>": [f"x{i}"], "date": DAY.date(),
            }.get(kind)
            if field.name in given:
                row[field.name] = given[field.name](i)
        made.append(tuple(row[f.name] for f in empty.schema))
    return spark.createDataFrame(made, empty.schema)


def check(before, after, untouched, key="id", added=()):
    """``untouched`` are keys whose rows must come out as they went in."""
    assert sorted(after.columns) == sorted([*before.columns, *added])
    same = before.where(F.col(key).isin(untouched)).exceptAll(after.where(F.col(key).isin(untouched)).select(before.columns))
    assert same.count() == 0


def test_transition(spark):
    queue = stored(spark, "queue")
    outcomes = spark.createDataFrame([(1, True, None, 5, 2), (2, False, "boom", 5, 0)], "id bigint, success boolean, error string, seconds int, contacts int")
    check(queue, jobs.transition(queue, outcomes, AS_OF), [3, 4, 5, 6])


@pytest.mark.parametrize("change", [jobs.expire, lambda q, _, as_of: jobs.stop_all(q, as_of)])
def test_failing_jobs(spark, change):
    queue = stored(spark, "queue", status=lambda i: "in_progress" if i == 1 else "done")
    starts = spark.createDataFrame([(1, DAY), (2, DAY)], "id bigint, started_at timestamp_ntz")
    after = change(queue, starts, AS_OF)
    check(queue, after, [2, 3, 4, 5, 6])
    assert after.where("status = 'failed'").count() == 1


def test_expired_sessions(spark):
    sessions = stored(spark, "sessions", deleted_at=lambda i: None, active=lambda i: True, expires_at=lambda i: DAY if i == 1 else DAY + datetime.timedelta(90))
    after = jobs.expire_sessions(sessions, AS_OF)
    check(sessions, after, [2, 3, 4, 5, 6])
    assert after.where("not active").count() == 1


@pytest.mark.parametrize("table, counter", [("proxies", "total_requests"), ("sessions", "usage_count")])
def test_touch(spark, table, counter):
    rows = stored(spark, table)
    after = proxies.touch(rows, spark.createDataFrame([(1,), (1,)], "id bigint"), counter, AS_OF)
    check(rows, after, [2, 3, 4, 5, 6])


def test_results(spark):
    pool = stored(spark, "proxies")
    log = [(1, DAY, 1, True, 9), (2, DAY, 2, False, None)]
    results = spark.createDataFrame(log, "event_id bigint, ts timestamp_ntz, proxy_id bigint, success boolean, response_time_ms int")
    after = proxies.apply_results(pool, results)
    check(pool, after, [3, 4, 5, 6])
    kept = {r["id"]: r["last_success_at"] for r in after.collect()}
    assert kept[2] == DAY + datetime.timedelta(2) and kept[1] == DAY


def test_probes(spark):
    pool = stored(spark, "proxies")
    probes = spark.createDataFrame([(1, True, 9)], "proxy_id bigint, success boolean, response_time_ms int")
    check(pool.drop("response_time_ms"), proxies.probe_update(pool, probes).drop("response_time_ms"), [2, 3, 4, 5, 6])


def test_new_proxies(spark):
    pool = stored(spark, "proxies")
    new = spark.createDataFrame(
        [(1, "scheme1", "host1", 1, "username1", "pw", False), (2, "http", "new", 1, None, "pw", True)],
        "ord bigint, scheme string, host string, port int, username string, password string, active boolean",
    )
    after = merge.merge_proxies(pool, new, AS_OF)
    check(pool, after, [2, 3, 4, 5, 6])
    assert after.count() == 7


def test_seen_urls(spark):
    store = stored(spark, "seen_urls")
    batch = spark.createDataFrame([("url1", DAY), ("https://new.org/", DAY)], "url string, visited_at timestamp_ntz")
    after = merge.merge_seen(store, batch)
    check(store.withColumn("visit_count", F.col("visit_count").cast("bigint")), after, [2, 3, 4, 5, 6])
    assert after.count() == 7 and after.where("url = 'url1' and job_id = 1 and url_hash = 'url_hash1'").count() == 1


def test_contacts(spark):
    base = stored(spark, "contacts", deleted_at=lambda i: DAY if i == 6 else None)
    items = spark.createDataFrame(
        [("email1", "a much longer name of a person", "o", DAY, 1), ("new@acme.org", "New Name", None, DAY, 2)],
        "email string, name string, org string, seen_at timestamp_ntz, item_id bigint",
    )
    after = merge.merge_contacts(base, items, AS_OF)
    check(base, after, [2, 3, 4, 5, 6], added=("action", "items"))
    assert after.count() == 7


def test_settings(spark):
    base = stored(spark, "settings")
    new = base.where("key in ('key1', 'key2')").withColumns({"key": F.when(F.col("key") == "key1", "other").otherwise(F.col("key")), "value": F.lit("new")})
    for mode in ("nothing", "replace"):
        after = merge.merge_settings(base, new, mode)
        check(base, after, ["key1", "key3", "key4"], "key")
        assert after.count() == 7
