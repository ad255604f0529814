"""URL filters and top-k search."""

import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlops.llm import queries, topk, url_cascade
from crawlops.llm.topk import top_k
from crawlops.llm.url_cascade import cascades, judge
from tests.conftest import SMALL, rows


@pytest.mark.parametrize("share", [0, 0.01, 0.5, 0.99, 1])
def test_cascade_is_exact(spark, share):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(100)) < int(share * 100)).alias("listed"))
    found = cascades(keys).flag(keys, "key", "said")
    assert found.where("said <> listed").count() == 0 and found.count() == 3000


def test_cascade_in_parts(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "SHARDS_HELD", 2)
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    made = cascades(keys, shard_keys=100)
    assert len(made.levels) == 7 and made.flag(keys, "key", "said").where("said <> listed").count() == 0


URLS = [
    (1, "https://Example.ORG/es/a?x#y"), (2, "http://a.example.org/en/17"), (3, "http://b.example.org/en/2"), (4, "http://x.com/de/"),
    (5, "http://x.com/fr"), (6, "http://x.com/en/"), (7, None), (8, "no scheme"), (9, "http://org"), (10, "http://badexample.org/es/"),
    (11, "://com/de/q://r"), (None, "http://x.com/zz"), (6, "http://x.com/en/"), (12, "http://ÄB.com?://q/de/"), (13, ""),
]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in URLS], "page_id long, url string, host string, rule string")
    wanted = collections.Counter(
        [
            (1, "example.org", "/es/a", "example.org/es/", "block"), (2, "a.example.org", "/en/17", "example.org/en/1", "block"),
            (3, "b.example.org", "/en/2", "org/", "allow"), (4, "x.com", "/de/", "com/de/", "block"), (5, "x.com", "/fr", None, "block"),
            (6, "x.com", "/en/", None, "block"), (6, "x.com", "/en/", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
            (9, "org", "", None, "allow"), (10, "badexample.org", "/es/", "org/", "allow"), (11, "com", "/de/q://r", "com/de/", "block"),
            (None, "x.com", "/zz", None, "block"), (12, "Äb.com", "", None, "allow"), (13, "", "", None, "allow"),
        ]
    )
    found = judge(pages, queries.URL_RULES)
    assert collections.Counter(map(tuple, found.select("page_id", "host", "path", "rule", "verdict").collect())) == wanted
    assert judge(pages.limit(0), queries.URL_RULES).count() == 0


def plain_top(vectors, asked, k):
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i in asked}):
        own = min(v for i, v in whole if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return out


VECTORS = st.lists(st.tuples(st.integers(0, 30), st.lists(st.sampled_from([-1.5, -0.2, 0.0, 0.1, 0.3, 2.0]), min_size=9, max_size=9)), min_size=1, max_size=40)


@settings(max_examples=40, deadline=None)
@given(VECTORS)
def test_bounds_keep_the_best(found):
    ids = np.array([i for i, _ in found])
    whole = np.floor(1024 * np.array([v for _, v in found]))
    best = topk.Best(ids[:3], whole[:3], 4)
    for at in range(0, len(ids), 5):
        best.add(ids[at : at + 5], whole[at : at + 5])
    for q, (scores, who) in enumerate(best.found):
        wanted = sorted((-int(s), int(i)) for s, i in zip(whole @ whole[q], ids) if i != ids[q])[:4]
        assert [(-int(s), int(i)) for s, i in zip(scores, who)] == wanted


def test_odd_vectors(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []),
        (8, [0.1]), (None, [1.0, 1.0]), (9, [0.3, 0.4]), (9, [0.3, 0.4]), (10, [-0.001, 3.0]), (20, [0.2, 0.2]), (20, [0.1, 0.9]),
    ]
    made = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, rank int")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    wanted = sorted(plain_top(exact, {0, 10, 20}, 4), key=repr)
    asked = made.where("vec_id % 10 = 0")
    assert rows(top_k(made, asked, 4), "query_id", "rank", "vec_id", "score") == wanted
    monkeypatch.setattr(topk, "QUERIES", 1)
    assert rows(top_k(made, asked, 4), "query_id", "rank", "vec_id", "score") == wanted
    assert top_k(made.limit(0), asked.limit(0)).count() == 0 and top_k(made, asked.limit(0)).count() == 0


def test_wide_scores(spark):
    vectors = [(0, [2e6, 1e6]), (1, [1e6, 2e6]), (2, [1e18, 1.0]), (3, [-1e18, 1.0])]
    made = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = rows(top_k(made, made.where("vec_id = 0"), 3), "rank", "vec_id", "score")
    assert found == [(1, 2, 2**63 - 1), (2, 1, 1024**2 * 4 * 10**12), (3, 3, -(2**63))]


def test_table_against_all_pairs(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = rows(queries.QUERIES["op10_top_k"](spark, SMALL), "query_id", "rank", "vec_id", "score")
    assert found == sorted(plain_top(vectors, {i for i, _ in vectors if i % 100 == 0}, 10), key=repr)
