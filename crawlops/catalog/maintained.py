"""Stored tables that are changed in place of being made anew, with the SQL over the whole tables that checks them."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from crawlops.catalog.joins import MERGED, SEEN_UPSERT, SHOWN, stored
from crawlops.catalog.registry import query
from crawlops.catalog.reports import BY_COUNTRY, RETAINED_LOGS, SEARCH, TEXT_SEARCH
from crawlops.fixtures import AS_OF, JOBS_AS_OF
from crawlops.operators import filters, merge, textindex
from crawlops.operators.dayparts import expire_days, read_days, store_days
from crawlops.operators.skew import match
from crawlops.operators.stored import dealt_as, save_bucketed
from crawlops.operators.textindex import TextIndex, grams_of, words_of
from crawlops.session import at, scratch
from crawlops.streaming import jobs as streams
from crawlops.streaming import views
from crawlops.streaming.store import Store

BUCKETS = 16


@query("contact_upsert_stored", MERGED)
def _(t):
    """The contacts lie in buckets by e-mail and are merged where they lie."""
    base = save_bucketed(stored(t), ["email"], BUCKETS, "contacts")
    items = merge.clean_items(t.contact_items).where("verdict = 'valid'")
    return merge.merge_contacts(base, dealt_as(items, ["email"], BUCKETS), JOBS_AS_OF).select(*SHOWN)


@query("contact_runs", f"SELECT email, name, org, phone, country, url, query_id, created_at, deleted_at, updated_at FROM ({MERGED})")
def _(t):
    """The items come in three changes, in order of time; each writes the contacts that it touches."""
    store, rest = streams.contact_store(stored(t).withColumn("updated_at", F.lit(None).cast("timestamp_ntz")), scratch(t.spark, "contacts"))
    us = F.unix_micros(F.col("seen_at").cast("timestamp"))
    low, high = t.contact_items.select(us.cast("double").alias("us")).approxQuantile("us", [1 / 3, 2 / 3], 0.01)
    for i, part in enumerate((us < low, (us >= low) & (us < high), us >= high)):
        streams.merge_items(store, i, t.contact_items.where(part), JOBS_AS_OF)
    return store.read().unionByName(rest, allowMissingColumns=True).select(
        "email", "name", "org", "phone", "country", "url", "query_id", "created_at", "deleted_at", "updated_at"
    )


@query("seen_upsert_stored", SEEN_UPSERT)
def _(t):
    """The seen URLs lie in buckets by URL; the visits of a batch come to them."""
    empty = t.seen_urls.where("false").select(
        "url", F.col("url").alias("normalized_url"), F.col("visited_at").alias("first_seen_at"),
        F.col("visited_at").alias("last_seen_at"), F.lit(0).cast("bigint").alias("visit_count"),
    )
    base = merge.merge_seen(empty, t.seen_urls.where("page_id % 3 < 2"))
    base = base.withColumns({"processing_status": F.lit("processed"), "url_hash": F.md5("url")})
    later = t.seen_urls.where("page_id % 3 > 0").withColumn("visited_at", F.col("visited_at") + F.expr("INTERVAL '40' DAY"))
    return merge.merge_seen(save_bucketed(base, ["url"], BUCKETS, "seen"), dealt_as(later, ["url"], BUCKETS))


def country_view(as_of) -> views.View:
    since = F.to_date(at(as_of)).cast("timestamp_ntz") - F.expr("INTERVAL '7' DAY")
    return views.View(
        ["country", "theme"],
        {
            "total_contacts": F.lit(1), "verified_contacts": F.coalesce("verified", F.lit(False)).cast("int"),
            "recent_contacts": F.coalesce(F.col("created_at") >= since, F.lit(False)).cast("int"),
        },
        {"last_contact_date": F.col("created_at")},
    )


def shown(contacts):
    """Rows that the summary counts."""
    return contacts.where("deleted_at IS NULL AND country IS NOT NULL").select("id", "country", "theme", "verified", "created_at")


@query("view_maintained", BY_COUNTRY)
def _(t):
    """A summary that begins with other contacts and sees updates, inserts and deletions until they are those of the table."""
    final, view = shown(t.contacts), country_view(AS_OF)
    later = F.col("created_at") + F.expr("INTERVAL '30' DAY")
    moved = final.where("id % 5 = 1").withColumns({"created_at": later, "verified": F.lit(True)})
    phantom = final.where("id % 7 = 2").withColumns({"id": -F.col("id"), "created_at": later})
    kept = final.where("id % 3 <> 0")
    states = [
        kept.where("id % 5 <> 1").unionByName(moved.where("id % 3 <> 0")).unionByName(phantom),
        kept.unionByName(phantom), final.unionByName(phantom), final,
    ]
    changes = [
        views.signed(states[0].where("false"), states[0]), views.signed(moved.where("id % 3 <> 0"), kept.where("id % 5 = 1")),
        views.signed(final.where("false"), final.where("id % 3 = 0")), views.signed(phantom, final.where("false")),
    ]
    store = Store(t.spark, scratch(t.spark, "view"), "_key")
    for i, (change, state) in enumerate(zip(changes, states), -1):
        views.apply_changes(store, i, view, change, functools.partial(rows_in, state))
    return views.read_view(store, view)


def rows_in(state, groups):
    """Rows of the groups; NULL is a group of its own."""
    return match(state, groups, ["country", "theme"], "left_semi")


@query("text_search_indexed", TEXT_SEARCH)
def _(t):
    """The posting lists of the words say which contacts hold them all."""
    index = TextIndex(t.spark, scratch(t.spark, "words")).build(t.contacts, words_of(["name", "org", "email"]))
    return textindex.text_search(t.contacts, index, ["consulting", "NATION_3"]).select("id", "name", "org", "email")


@query("contact_search_indexed", SEARCH.format("GMAIL", "AND country = 'NATION_3'"))
def _(t):
    """Contacts that hold all three-letter runs of the text are searched, instead of all."""
    index = TextIndex(t.spark, scratch(t.spark, "grams")).build(t.contacts, grams_of(["name", "email", "org"]))
    return filters.search_contacts(textindex.may_contain(t.contacts, index, "GMAIL"), "GMAIL", "NATION_3")


@query("retention_logs_by_day", RETAINED_LOGS)
def _(t):
    """Expired days of the log go as folders, the border day is written anew."""
    folder = scratch(t.spark, "logs")
    store_days(t.system_logs, "log_ts", folder)
    expire_days(t.spark, folder, "log_ts", 10, AS_OF)
    return read_days(t.spark, folder).select("id", "log_ts", "level")
