"""Plans of the batch queries: built-in operators only, no product joins, no unpartitioned windows over data."""

import re

import pytest

from crawlops.catalog import load
from tests.conftest import SMALL

QUERIES = load().QUERIES
BATCH = sorted(n for n in QUERIES if not n.startswith(("stream_", "sink_")))


@pytest.mark.parametrize("name", BATCH)
def test_plan(name, spark):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark):
    plan = QUERIES["retention_logs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts" in plan or "Or(" in plan
    plan = QUERIES["js_quota"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,event_type:string>", plan)


def test_top_pages_are_limited_before_the_shuffle(spark):
    plan = QUERIES["page_cap"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top_k_needs_no_full_sort(spark):
    plan = QUERIES["job_claim"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
