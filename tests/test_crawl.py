"""Crawl order, sticky blocks and weighted draws against plain loops over small inputs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from crawlops.fixtures import AS_OF
from crawlops.operators import proxies
from crawlops.plans import frontier
from tests.conftest import rows


def crawl(seeds, edges, max_pages, per_page):
    """Page by page in visit order: the first links that nobody has claimed yet."""
    links = defaultdict(dict)
    for src, dst, rank in edges:
        links[src][dst] = min(rank, links[src].get(dst, rank))
    out, by_job = [], defaultdict(list)
    for job, node in sorted(set(seeds)):
        by_job[job].append(node)
    for job, nodes in by_job.items():
        order = [(n, 0) for n in nodes[:max_pages]]
        claimed, at = {n for n, _ in order}, 0
        while at < len(order):
            node, depth = order[at]
            found = 0
            for _, dst in sorted((r, d) for d, r in links[node].items()):
                if found < per_page and dst not in claimed:
                    claimed.add(dst)
                    order.append((dst, depth + 1))
                    found += 1
            at += 1
        out += [(job, n, i, d) for i, (n, d) in enumerate(order[:max_pages], start=1)]
    return sorted(out, key=repr)


def test_crawl_order(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(7)) for _ in range(400)]
    seeds = [(j, rng.randrange(60)) for j in range(6) for _ in range(2)]
    for max_pages, per_page in ((20, 3), (60, 2)):
        found = frontier.crawl_expand(
            spark.createDataFrame(seeds, "job_id int, node int"), spark.createDataFrame(edges, "src int, dst int, rank int"), max_pages, per_page
        )
        assert rows(found, "job_id", "node", "visit_number", "depth") == crawl(seeds, edges, max_pages, per_page)


def test_links_of_a_sibling_are_passed_over(spark):
    """Two pages share their best five links: the second one takes the next five."""
    edges = [(0, 1, 0), (0, 2, 1)] + [(1, 10 + i, i) for i in range(5)] + [(2, 10 + i, i) for i in range(10)]
    seeds = spark.createDataFrame([(1, 0)], "job_id int, node int")
    found = frontier.crawl_expand(seeds, spark.createDataFrame(edges, "src int, dst int, rank int"))
    assert found.count() == 13


def test_crawl_goes_as_deep_as_the_cap_allows(spark):
    seeds = spark.createDataFrame([(1, 0)], "job_id int, node int")
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).alias("rank"))
    assert frontier.crawl_expand(seeds, edges, max_pages=12).count() == 12


def test_sticky_blocks(spark):
    rng = random.Random(5)
    requests, event = [], 0
    for job in range(4):
        second = 0
        for _ in range(300):
            second += rng.choice([0, 5, 40, 90, 200, 400])
            event += 1
            requests.append((event, job, second))
    wanted, start = {}, {}
    for event, job, second in requests:
        if job not in start or second >= start[job] + 300:
            start[job] = second
        wanted[event] = start[job] * 1_000_000
    df = spark.createDataFrame(requests, "event_id int, job_id int, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    found = {r.event_id: r.block_us for r in proxies.sticky_blocks(df, 300).collect()}
    assert found == wanted


def test_weights_decide_the_shares(spark, tables):
    pool = proxies.indexed_proxies(tables.proxies, AS_OF)
    hosts = [r.host for r in pool.orderBy("_index").collect()]
    heavy, none = hosts[0], hosts[1]
    requests = spark.range(4000).select(F.col("id").alias("event_id"))
    got = proxies.assign_weighted(requests, pool, "event_id", {"default": 1.0, heavy: float(len(hosts)), none: 0.0})
    assert got.count() == 4000
    share = {r.host: r["count"] for r in got.join(tables.proxies, F.col("proxy") == F.col("id")).groupBy("host").count().collect()}
    assert none not in share
    assert abs(share[heavy] / 4000 - len(hosts) / (2 * len(hosts) - 2)) < 0.05


def test_weightless_pool_uses_the_last_proxy(spark, tables):
    pool = proxies.indexed_proxies(tables.proxies, AS_OF)
    got = proxies.assign_weighted(spark.range(5).select(F.col("id").alias("event_id")), pool, "event_id", {"default": 0.0})
    last = pool.orderBy(F.desc("_index")).first().proxy
    assert {r.proxy for r in got.collect()} == {last}


def test_best_without_usable_proxy(spark, tables):
    requests = spark.range(3).select(F.col("id").alias("event_id"))
    assert proxies.assign_best(requests, tables.proxies.where("false"), AS_OF).isEmpty()
