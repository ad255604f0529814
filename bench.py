"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of cores.  Every query
runs once untimed on the smallest tables, when they are there, so that the times
are those of a running session.
"""

from __future__ import annotations

import json
import os
import re
import time

from crawlops.catalog import load
from crawlops.fixtures import PARTS
from crawlops.session import local_session

HEADLINES = [
    # reports
    "ops_overview_v2", "contacts_by_country_theme", "jobs_by_theme_day", "proxy_hourly", "error_summary", "log_summary",
    # expressions over whole texts
    "page_text", "text_clean", "lang_detect_spider", "lang_detect_markers", "contact_context", "emails_spider", "phones_spider",
    "theme_tags", "url_normalize", "keyword_match",
    # joins, merges, windows
    "seen_filter", "contact_upsert", "contacts_latest", "contacts_duplicates", "job_transition", "frontier_links",
    "proxy_failure_runs", "proxy_state_after", "counter_increase", "alerts",
    # assignment
    "assign_round_robin", "assign_weighted", "assign_sticky",
    # whole pipelines
    "extract_contacts", "pages_to_contacts", "ingest_contacts", "crawl_expand",
    # streams
    "stream_rates", "stream_breaker",
]


def store(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(PARTS, str(spark.sparkContext.defaultParallelism))
    queries = load().QUERIES
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in HEADLINES if os.path.isdir(small) else []:
        store(queries[name](spark, small))
    times = {}
    for name in HEADLINES:
        begin = time.perf_counter()
        store(queries[name](spark, folder))
        times[name] = round(time.perf_counter() - begin, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
