"""Link selection and breadth-first crawl expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlops.functions.urls import link_allowed, url_domain, url_join
from crawlops.operators.once import once
from crawlops.operators.skew import HOT_ROWS, skew_join
from crawlops.session import cut

ANCHOR = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>([^<]*)"""


def page_links(pages: DataFrame) -> DataFrame:
    """Admitted links of every page, each URL once with its best class and first place.

    Classes: contact, about, team, staff in the link; Contact, About in its text; all others.
    """
    anchors = F.regexp_extract_all(F.col("html"), F.lit(ANCHOR), F.lit(0))  # the page is searched once, the parts lie in each anchor
    pairs = F.transform(anchors, lambda a: F.struct(F.regexp_extract(a, ANCHOR, 1).alias("href"), F.regexp_extract(a, ANCHOR, 2).alias("label")))
    found = once(pages.select("page_id", "url", "html"), links=pairs, netloc=url_domain("url")).select(
        "page_id", F.col("url").alias("page_url"), "netloc", F.posexplode("links").alias("pos", "link")
    )
    href, label = F.replace(F.col("link.href"), F.lit("&amp;"), F.lit("&")), F.col("link.label")
    rank = F.lit(7)
    for i, cond in reversed(list(enumerate([
        href.contains("contact"), href.contains("about"), href.contains("team"), href.contains("staff"),
        label.contains("Contact"), label.contains("About"),
    ], start=1))):
        rank = F.when(cond, i).otherwise(rank)
    links = once(found, url=url_join("page_url", href)).where(link_allowed("url", "netloc"))
    return (
        links.select("page_id", "url", F.struct(rank.alias("rank"), "pos").alias("place"))
        .groupBy("page_id", "url")
        .agg(F.min("place").alias("place"))
        .select("page_id", "url", "place.rank", "place.pos")
    )


def frontier(pages: DataFrame, seen: DataFrame, k: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first ``k`` links of each page that were not seen before.

    The links are stored once: many pages may share a target, and finding such
    targets must not parse the pages again.
    """
    links = cut(page_links(pages))
    new = skew_join(links, seen.select("url").distinct(), ["url"], "left_anti", hot_rows)
    w = Window.partitionBy("page_id").orderBy("rank", "pos")
    return new.withColumn("link_number", F.row_number().over(w)).where(F.col("link_number") <= k)


def crawl_expand(seeds: DataFrame, edges: DataFrame, max_pages: int = 25, links_per_page: int = 5) -> DataFrame:
    """Breadth-first visit order of every job over a link table, until no new page is left or ``max_pages`` are visited.

    ``seeds`` has job_id and node, ``edges`` has src, dst and rank.  Pages of a level choose in
    visit order: each takes its first ``links_per_page`` links that neither an earlier level
    nor an earlier page has claimed.  A level is one equi join and one fold per job;
    as a page's choice depends on at most ``max_pages`` others, ``max_pages * links_per_page``
    of its links are enough, so the fold sees a bounded array.
    """
    first, kind = F.row_number().over(Window.partitionBy("job_id").orderBy("node")), edges.schema["dst"].dataType
    visited = cut(
        seeds.select("job_id", F.col("node").cast(kind).alias("node")).distinct().withColumn("visit_number", first)
        .where(F.col("visit_number") <= max_pages).withColumn("depth", F.lit(0))
    )
    links = edges.groupBy("src", "dst").agg(F.min("rank").alias("rank"))
    for depth in range(1, max_pages + 1):  # every level visits a page of each job that goes on
        level = visited.where(F.col("depth") == depth - 1)
        counts = visited.groupBy("job_id").agg(F.max("visit_number").alias("so_far")).where(F.col("so_far") < max_pages)
        steps = (
            level.join(counts, "job_id")
            .join(links, F.col("node") == F.col("src"))
            .select("job_id", F.col("visit_number").alias("parent"), F.col("dst").alias("node"), "rank", "so_far")
            .join(visited.select("job_id", "node"), ["job_id", "node"], "left_anti")
        )
        per_page = Window.partitionBy("job_id", "parent").orderBy("rank", "node")
        offered = (
            steps.withColumn("_n", F.row_number().over(per_page)).where(F.col("_n") <= max_pages * links_per_page)
            .groupBy("job_id", "so_far", "parent").agg(F.array_sort(F.collect_list(F.struct("_n", "node"))).alias("_links"))
        )
        jobs = offered.groupBy("job_id", "so_far").agg(F.array_sort(F.collect_list(F.struct("parent", "_links"))).alias("_pages"))
        nothing = F.array().cast(f"array<{kind.simpleString()}>")
        claimed = F.aggregate(
            "_pages", nothing,
            lambda done, page: F.concat(done, F.slice(F.array_except(F.transform(page["_links"], lambda x: x["node"]), done), 1, links_per_page)),
        )
        fresh = (
            jobs.select("job_id", "so_far", F.posexplode(claimed).alias("_place", "node"))
            .withColumn("visit_number", (F.col("so_far") + F.col("_place") + 1).cast("int"))
            .where(F.col("visit_number") <= max_pages)
            .select("job_id", "node", "visit_number", F.lit(depth).alias("depth"))
        )
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        visited = cut(visited.unionByName(fresh))
    return visited
