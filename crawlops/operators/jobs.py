"""Job queue: expansion, pages of a job, state transitions, resume points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlops.functions.lang import keywords, keywords_form
from crawlops.functions.text import strip
from crawlops.functions.urls import url_domain, url_valid
from crawlops.operators.skew import HOT_ROWS, attach_stats, cut_hot, done, match, pair_join, running
from crawlops.session import at, seconds_between

EXPIRED = "job expired: scheduler timeout"
STOPPED = "stopped by the administrator"


def expand_jobs(
    forms: DataFrame, countries: Sequence[str] | None, proxies: DataFrame, as_of, language: str = "auto"
) -> DataFrame:
    """One pending job per URL line and country of every form.

    A form with an invalid URL or without keywords gives no job, and without an
    active proxy no form does.  ``forms`` has form_id, urls and keywords.
    """
    urls = F.filter(F.transform(F.split("urls", "\r?\n"), strip), lambda u: u != "")
    wanted = F.array(*[F.lit(c) for c in countries]) if countries else F.array(F.lit(None).cast("string"))
    lang = F.lit(None).cast("string") if language == "auto" else F.lit(language)
    ready = (
        forms.withColumns({"_urls": urls, "custom_keywords": keywords_form("keywords")})
        .where((F.size("_urls") > 0) & F.forall("_urls", url_valid) & (F.size("custom_keywords") > 0))
        .where(proxies.where("active").select("id").exists())
    )
    return ready.select("form_id", "custom_keywords", F.posexplode("_urls").alias("line", "url")).select(
        "form_id", "line", "url", F.explode(wanted).alias("country_filter"), lang.alias("lang_filter"),
        F.to_json("custom_keywords").alias("custom_keywords"), F.lit("pending").alias("status"), at(as_of).alias("created_at"),
    )


def cap_pages(df: DataFrame, key: str, order: Sequence[str], most: int = 25) -> DataFrame:
    """At most ``most`` pages per key in visit order; each task keeps its own best before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("visit_number", F.row_number().over(w)).where(F.col("visit_number") <= most)


def cap_by_host(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages with their host; with a cap the first ones of every host in visit order.

    The cap is taken on page ids, so texts are not sorted.
    """
    hosted = pages.withColumn("netloc", url_domain("url")).where("netloc <> ''")
    if max_pages is None:
        return hosted
    first = cap_pages(hosted.select("page_id", "netloc"), "netloc", ["page_id"], max_pages)
    return hosted.join(first.select("page_id"), "page_id", "left_semi")


def on_host(queue: DataFrame, pages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pages with the jobs whose start URL is on their host; pages and jobs of crowded hosts are dealt out.

    A job runs through pages, not a page through jobs: callers that list pages need their ids only, so little is read per pair.
    """
    jobs = queue.select(
        F.col("id").alias("query_id"), F.col("url").alias("seed_url"), "custom_keywords", "match_mode", "min_matches",
        "country_filter", url_domain("url").alias("netloc"),
    )
    joined = ["netloc", *[c for c in (*pages.columns, *jobs.columns) if c != "netloc"]]
    return pair_join(jobs, pages, ["netloc"], ["query_id"], ["page_id"], hot_rows).select(*joined)


def job_pages(queue: DataFrame, pages: DataFrame, max_pages: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pages on the host of each job's start URL, at most ``max_pages`` per job if given.

    The cap is taken per host before the join.
    """
    return on_host(queue, cap_by_host(pages, max_pages), hot_rows)


def job_classes(queue: DataFrame) -> DataFrame:
    """Jobs with the class they belong to: same host, keywords, mode and minimum, so the same pages pass for all of them.

    ``class_id`` is the smallest job id of the class.  What is found on pages is found once per class; the jobs
    of a class are joined where a row per job is wanted.
    """
    jobs = queue.select(
        F.col("id").alias("query_id"), F.col("url").alias("seed_url"), "country_filter", url_domain("url").alias("netloc"),
        keywords("custom_keywords").alias("words"), "match_mode", "min_matches",
    ).where("netloc <> ''")
    keys = ["netloc", "words", "match_mode", "min_matches"]
    return match(jobs, jobs.groupBy(*keys).agg(F.min("query_id").alias("class_id")), keys)


def stuck_jobs(queue: DataFrame, starts: DataFrame, as_of, seconds: int = 3600) -> DataFrame:
    """Jobs in progress that started more than ``seconds`` ago; ``starts`` has id and started_at."""
    old = starts.where(seconds_between(at(as_of), F.col("started_at")) > seconds)
    return queue.where(F.col("status") == "in_progress").join(old.select("id"), "id", "left_semi")


def transition(
    queue: DataFrame, outcomes: DataFrame, as_of, retry_minutes: int = 30, as_written: bool = False
) -> DataFrame:
    """Job rows after their runs.

    ``outcomes`` has id, success, error, seconds and contacts.  Failures are tried
    again while retries are left, except timeouts.  Every failed run adds one
    retry and a pause; ``as_written`` does so only for jobs that failed for good.
    """
    o = outcomes.select(
        "id", F.col("success").alias("_success"), F.col("error").alias("_error"),
        F.col("seconds").alias("_seconds"), F.col("contacts").alias("_contacts"),
    )
    ran, ok = F.col("_success").isNotNull(), F.col("_success")
    timed_out = F.lower(F.coalesce("_error", F.lit(""))).contains("timeout")
    again = (F.coalesce("retry_count", F.lit(0)) < F.coalesce("max_retries", F.lit(3))) & ~timed_out
    status = F.when(ok, "done").when(again, "pending").otherwise("failed")
    counted = ran & ~ok & (~again if as_written else F.lit(True))
    pause = at(as_of) + F.make_dt_interval(mins=F.lit(retry_minutes))
    took = F.coalesce("_seconds", "execution_time_seconds") if "execution_time_seconds" in queue.columns else F.col("_seconds")
    return (
        queue.join(o, "id", "left")
        .withColumns(
            {
                "status": F.when(ran, status).otherwise(F.col("status")),
                "last_error": F.when(ran & ~ok & (F.coalesce("_error", F.lit("")) != ""), F.col("_error")).otherwise(F.col("last_error")),
                "execution_time_seconds": took,
                "contacts_extracted": F.when(ran & ok, F.coalesce("_contacts", F.lit(0))).otherwise(F.col("contacts_extracted")),
                "retry_count": F.when(counted, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
                "next_retry_at": F.when(counted, pause).otherwise(F.col("next_retry_at")),
                "updated_at": F.when(ran, at(as_of)).otherwise(F.col("updated_at")),
            }
        )
        .drop("_success", "_error", "_seconds", "_contacts")
    )


def _fail(df: DataFrame, hit: Column, message: str, as_of, retry_minutes: int) -> DataFrame:
    changes = {
        "status": F.lit("failed"), "last_error": F.lit(message), "updated_at": at(as_of),
        "retry_count": F.col("retry_count") + 1, "next_retry_at": at(as_of) + F.make_dt_interval(mins=F.lit(retry_minutes)),
    }
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def expire(queue: DataFrame, starts: DataFrame, as_of, timeout_minutes: int = 60, retry_minutes: int = 30) -> DataFrame:
    """Jobs in progress for longer than the timeout become failed."""
    late = seconds_between(at(as_of), F.col("_started")) > timeout_minutes * 60
    hit = F.coalesce((F.col("status") == "in_progress") & late, F.lit(False))
    joined = queue.join(starts.select("id", F.col("started_at").alias("_started")), "id", "left")
    return _fail(joined, hit, EXPIRED, as_of, retry_minutes).drop("_started")


def stop_all(queue: DataFrame, as_of, retry_minutes: int = 30) -> DataFrame:
    """All jobs in progress become failed."""
    return _fail(queue, F.col("status") == "in_progress", STOPPED, as_of, retry_minutes)


def resume_points(df: DataFrame, as_of) -> DataFrame:
    """Newest active checkpoint of each job and phase that is still valid."""
    good = df.where(F.col("is_active") & (F.col("valid_until").isNull() | (F.col("valid_until") > at(as_of))))
    rest = [c for c in df.columns if c not in ("job_id", "phase")]
    newest = F.max_by(F.struct(*rest), F.struct("checkpoint_at", "id"))
    return good.groupBy("job_id", "phase").agg(newest.alias("_row")).select("job_id", "phase", "_row.*")


def number_runs(runs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Runs numbered per job by start time, with their duration."""
    pieces = running(cut_hot(runs, ["job_id"], ["started_at", "id"], hot_rows), sums={"run_number": F.lit(1)})
    return done(pieces.df).withColumn("seconds", seconds_between(F.col("finished_at"), F.col("started_at")))


def content_changes(visits: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Visits whose content differs from the visit before."""
    pieces = running(
        cut_hot(visits, ["url_hash"], ["visited_at", "visit_id"], hot_rows), previous={"previous_hash": F.col("content_hash")}
    )
    return done(pieces.df).where(F.col("previous_hash") != F.col("content_hash"))


def link_duplicates(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Copies point to the first contact with the same hash."""
    out = attach_stats(
        df, ["contact_hash"], {"_first": F.min("id"), "_members": F.count(F.lit(1))}, hot_rows
    )
    primary = F.col("id") == F.col("_first")
    return (
        out.withColumn("is_primary", primary)
        .withColumn("duplicate_of", F.when(~primary, F.col("_first")))
        .withColumn("merge_count", F.when(primary, F.col("_members") - 1).otherwise(0))
        .drop("_first", "_members")
    )


def expire_sessions(df: DataFrame, as_of, note: str = " [auto-disabled: expired]") -> DataFrame:
    """Active live sessions past their expiry become inactive, with a note."""
    hit = F.coalesce(F.col("active") & F.col("deleted_at").isNull() & (F.col("expires_at") < at(as_of)), F.lit(False))
    return df.withColumns(
        {
            "active": F.when(hit, False).otherwise(F.col("active")),
            "notes": F.when(hit, F.concat(F.coalesce("notes", F.lit("")), F.lit(note))).otherwise(F.col("notes")),
            "updated_at": F.when(hit, at(as_of)).otherwise(F.col("updated_at") if "updated_at" in df.columns else F.lit(None)),
        }
    )
