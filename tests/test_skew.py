"""Cutting hot groups never changes a result."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from crawlops.functions import contact
from crawlops.operators import jobs, merge, proxies, skew
from crawlops.plans import alerts, extract
from tests.conftest import rows


@pytest.fixture(scope="module")
def crowded(tables):
    """Results of which one proxy holds more than a third."""
    one = F.when(F.col("event_id") % 5 < 2, 1).otherwise(F.col("proxy_id"))
    return tables.proxy_results.withColumn("proxy_id", one.cast("bigint"))


@pytest.fixture(scope="module")
def samples(tables):
    one = F.when(F.col("event_id") % 2 == 0, "up").otherwise(F.col("metric"))
    return tables.samples.withColumns({"metric": one, "instance": F.lit("n1")})


def test_finds_the_hot_key(crowded):
    assert skew.hot_keys(crowded, ["proxy_id"], 10_000_000) is None
    assert (1,) in [tuple(r) for r in skew.hot_keys(crowded, ["proxy_id"], 100).names.collect()]


def check_pieces(df, order, limit, at_least):
    sizes = df.groupBy("_piece").count()
    assert sizes.count() > at_least and sizes.agg(F.max("count")).first()[0] <= 2 * limit
    ends = df.groupBy("_piece").agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b")).orderBy("_piece").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:], strict=False))


def test_cuts_into_pieces(crowded):
    pieces = skew.cut_hot(crowded, ["proxy_id"], ["ts", "event_id"], 4)
    check_pieces(pieces.df.where("proxy_id = 1"), ["ts", "event_id"], 4, 64)


def test_cuts_rows_of_one_time(crowded):
    at_once = crowded.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    pieces = skew.cut_hot(at_once, ["proxy_id"], ["ts", "event_id"], 10)
    check_pieces(pieces.df.where("proxy_id = 1"), ["ts", "event_id"], 10, 20)
    cols = ("event_id", "failure_run")
    assert rows(proxies.failure_runs(at_once, 10), *cols) == rows(proxies.failure_runs(at_once), *cols)


def test_plans_of_crowded_keys_move_narrow_rows(crowded, samples):
    """No cut points travel with the rows, and no product join is needed."""
    for found in (proxies.failure_runs(crowded, 20), alerts.increase(samples, 6 * 3600, 20)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "_cuts" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_failure_runs(crowded):
    cols = ("event_id", "failure_run")
    assert rows(proxies.failure_runs(crowded, 20), *cols) == rows(proxies.failure_runs(crowded), *cols)


def test_proxy_state(tables, crowded):
    ours = proxies.apply_results(tables.proxies, crowded, max_failures=2, hot_rows=20)
    assert rows(ours) == rows(proxies.apply_results(tables.proxies, crowded, max_failures=2))


def test_run_numbers(tables):
    runs = tables.job_runs.withColumn("job_id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("job_id")))
    cols = ("id", "run_number")
    assert rows(jobs.number_runs(runs, 10), *cols) == rows(jobs.number_runs(runs), *cols)


def test_content_changes(tables):
    visits = tables.events.select(
        F.col("event_id").alias("visit_id"), F.col("ts").alias("visited_at"),
        F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.col("user_id").cast("string")).alias("url_hash"),
        F.col("event_type").alias("content_hash"),
    )
    assert rows(jobs.content_changes(visits, 20)) == rows(jobs.content_changes(visits))


@pytest.mark.parametrize("hours", [6, 24 * 60])
def test_increase(samples, hours):
    """The longer window spans all samples of a series."""
    cols = ("event_id", "ts", "value", "resets", "increase", "rate")
    found, plain = rows(alerts.increase(samples, hours * 3600, 20), *cols), rows(alerts.increase(samples, hours * 3600), *cols)
    assert [r[:4] for r in found] == [r[:4] for r in plain]
    assert all(x == pytest.approx(y, rel=1e-12, abs=1e-6) for x, y in zip(found, plain) for x, y in zip(x[4:], y[4:]))


def dense_samples(spark):
    """Many samples of one time, none of some, and two series."""
    dice = random.Random(5)
    made = []
    for i in range(600):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=60 * dice.randrange(300)) if i % 50 else None
        made.append((i, at, dice.choice("ab"), "n", float(dice.randrange(1000)) / 8 if i % 41 else None))
    return made, spark.createDataFrame(made, "event_id long, ts timestamp_ntz, metric string, instance string, value double")


@pytest.mark.parametrize("seconds", [60, 61, 3600, 86_400])
def test_increase_by_hand(spark, seconds):
    """Rows of one time share a window; rows without a time are one of their own."""
    made, df = dense_samples(spark)
    expected = []
    for metric in "ab":
        series = sorted((r for r in made if r[2] == metric), key=lambda r: (r[1] or dt.datetime.min, r[0]))
        deltas, resets, last = [], [], None
        for r in series:
            lower = last is not None and r[4] is not None and r[4] < last
            deltas.append(0.0 if last is None else r[4] if lower else None if r[4] is None else r[4] - last)
            resets.append(int(lower))
            last = r[4]
        for r in series:
            inside = [
                k for k, o in enumerate(series)
                if (o[1] is None) == (r[1] is None) and (r[1] is None or dt.timedelta(0) <= r[1] - o[1] < dt.timedelta(seconds=seconds))
            ]
            known = [deltas[k] for k in inside if deltas[k] is not None]
            grown = None if not known or deltas[inside[0]] is None else round(sum(known) - deltas[inside[0]], 6)
            expected.append((r[0], grown, sum(resets[k] for k in inside) - resets[inside[0]]))
    assert rows(alerts.increase(df, seconds), "event_id", "increase", "resets") == sorted(expected, key=repr)


def test_increase_does_not_visit_windows_row_by_row(spark):
    """A frame that begins some time before a row is summed anew for every row."""
    plan = alerts.increase(dense_samples(spark)[1], 86_400)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding$(), -86400000000" in plan and not re.search(r"RangeFrame, -\d", plan)


def test_sustained(samples):
    judged = samples.select("event_id", "metric", "ts", (F.col("value") > 0).alias("cond"))
    assert rows(alerts.sustained(judged, ["metric"], F.lit(600), 20)) == rows(alerts.sustained(judged, ["metric"], F.lit(600)))


def test_link_duplicates(tables):
    hashed = tables.contact_items.select(
        F.col("item_id").alias("id"),
        F.when(F.col("item_id") % 3 == 0, "hot").otherwise(contact.contact_hash("email", "name", "org")).alias("contact_hash"),
    )
    assert rows(jobs.link_duplicates(hashed, 20)) == rows(jobs.link_duplicates(hashed))


def test_unseen(tables):
    crowd = tables.seen_urls.withColumn("url", F.when(F.col("visit_id") % 2 == 0, "http://a.org/x").otherwise(F.col("url")))
    seen = tables.seen_urls.where("page_id % 3 = 0")
    cols = ("visit_id", "scope", "normalized_url")
    assert rows(merge.unseen(crowd, seen, 20), *cols) == rows(merge.unseen(crowd, seen), *cols)


def test_job_pages(tables):
    one = F.when(F.col("page_id") % 2 == 0, "https://hot.org/x").otherwise(F.col("url"))
    queue = tables.pages.select(
        F.col("page_id").alias("id"), one.alias("url"), F.lit("contact").alias("custom_keywords"), F.lit("any").alias("match_mode"),
        F.lit(1).alias("min_matches"), F.lit(None).cast("string").alias("country_filter"),
    )
    pages = tables.corpus.select(
        F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 2 == 0, "https://hot.org/y").otherwise(F.col("url")).alias("url"), "text"
    )
    cols = ("query_id", "page_id")
    found = jobs.job_pages(queue, pages, 5, 10)
    assert rows(found, *cols) == rows(jobs.job_pages(queue, pages, 5), *cols)
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5
    assert rows(extract.extract_contacts(queue, pages, 5, 10)) == rows(extract.extract_contacts(queue, pages, 5))


def one_host(spark, n_pages, n_jobs):
    queue = spark.range(n_jobs).select(
        "id", F.format_string("https://hot.org/%d", "id").alias("url"), F.lit("contact").alias("custom_keywords"), F.lit("any").alias("match_mode"),
        F.lit(1).alias("min_matches"), F.when(F.col("id") % 2 == 0, "FRANCE").alias("country_filter"),
    )
    text = F.format_string("Contact: Marie Dubois, Ada.%d@mail.acme.org", "id")
    return queue, spark.range(n_pages).select(F.col("id").alias("page_id"), F.lit("https://hot.org/y").alias("url"), text.alias("text"))


def largest_part(df):
    return df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count")).first()[0]


def test_job_pages_of_one_host_are_dealt_out(spark):
    """Neither side is crowded, what they give together is."""
    queue, pages = one_host(spark, 300, 200)
    found = jobs.job_pages(queue, pages, hot_rows=1_000).select("query_id", "page_id")
    assert found.count() == found.distinct().count() == 60_000
    assert largest_part(found) <= 10_000


def test_job_pages_run_through_page_ids(spark):
    """What a job brings is read once for all pages of its cell, so the side that is run through has nothing but ids."""
    queue, pages = one_host(spark, 300, 200)
    found = jobs.job_pages(queue, pages, hot_rows=1_000).select("query_id", "page_id", "seed_url")
    join = found._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().head()
    outer, inner = (side.output().mkString(",") for side in (join.left(), join.right()))
    assert "seed_url" in outer and "page_id" in inner and "seed_url" not in inner
    assert jobs.job_pages(queue, pages, hot_rows=1_000).columns == jobs.job_pages(queue, pages).columns


def test_texts_of_a_crowded_host_are_searched_once(spark):
    """Dealing out a crowded host repeats the terms and classes, not the work on its pages."""
    queue, pages = one_host(spark, 120, 100)
    crowded, plain = (extract.class_contacts(jobs.job_classes(queue), pages, hot_rows=n) for n in (10, 1_000))
    searches = [df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") for df in (crowded, plain)]
    assert searches[0] == searches[1] > 0
    assert rows(crowded) == rows(plain) and len(rows(plain)) == 120


def test_contacts_of_one_class_are_dealt_out(spark):
    queue, pages = one_host(spark, 120, 100)
    found = extract.extract_contacts(queue, pages, hot_rows=500)
    assert found.count() == found.select("query_id", "page_id").distinct().count() == 12_000
    assert largest_part(found) <= 3_000
    added = extract.extract_contacts(queue, pages, hot_rows=500, derived={"size": F.length("raw_text")})
    assert rows(added.drop("size")) == rows(found) and added.where("size = length(raw_text)").count() == 12_000


def test_pair_join(tables):
    """Keys may be null, crowded on one side only or on none, and ids may come twice."""
    left = tables.orders.select(F.col("o_orderkey").alias("l"), F.when(F.col("o_orderkey") % 4 == 0, 1).when(F.col("o_orderkey") % 9 > 0, F.col("o_custkey")).alias("k"))
    right = tables.customer.select(F.col("c_custkey").alias("r"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 40).alias("k"))
    left, plain = left.unionByName(left.where("l < 50")), None
    for hot_rows in (1_000_000, 200, 1):
        found = rows(skew.pair_join(left, right, ["k"], ["l"], ["r"], hot_rows), "l", "r", "k")
        plain = plain or rows(left.join(right, "k"), "l", "r", "k")
        assert found == plain, hot_rows


def test_missing_keys_may_be_the_crowd(tables):
    """NULL is the hot key: a group for windows, no partner for joins."""
    holes = tables.proxy_results.withColumn("proxy_id", F.when(F.col("event_id") % 2 == 0, F.col("proxy_id")))
    cols = ("event_id", "failure_run")
    assert rows(proxies.failure_runs(holes, 20), *cols) == rows(proxies.failure_runs(holes), *cols)
    pool = tables.proxies.select(F.col("id").alias("proxy_id"), "host")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew.skew_join(holes, pool, ["proxy_id"], how, 20)) == rows(skew.skew_join(holes, pool, ["proxy_id"], how)), how
    counted = holes.select("event_id", "proxy_id")
    stats = {"n": F.count(F.lit(1)), "low": F.min("event_id")}
    assert rows(skew.attach_stats(counted, ["proxy_id"], stats, 20)) == rows(skew.attach_stats(counted, ["proxy_id"], stats))


def test_crowd_without_key_is_dealt_out(spark):
    left = spark.range(4_000).select("id", F.when(F.col("id") % 8 == 0, F.col("id") % 5).alias("k"))
    right = spark.range(4).select(F.col("id").alias("k"), F.col("id").alias("r"))
    for how, n in (("left", 4_000), ("left_anti", 3_600), ("inner", 400), ("left_semi", 400)):
        found = skew.skew_join(left, right, ["k"], how, 100)
        assert rows(found) == rows(skew.skew_join(left, right, ["k"], how)) and found.count() == n, how


def test_attach_stats_keeps_all_rows(tables):
    df = tables.events.select("event_id", F.when(F.col("event_id") % 3 < 2, 0).otherwise(F.col("user_id")).alias("k"))
    out = skew.attach_stats(df, ["k"], {"n": F.count(F.lit(1))}, 50)
    assert out.count() == df.count()
