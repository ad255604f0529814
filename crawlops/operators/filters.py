"""Row filters, listings and top-k reports over the operational tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlops.functions.contact import email_domain
from crawlops.session import at

EPOCH = "1970-01-01 00:00:00"


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(F.col("deleted_at").isNull())


def search_contacts(
    df: DataFrame, text: str | None = None, country: str | None = None, limit: int = 500, literal: bool = False
) -> DataFrame:
    """Newest live contacts whose name, e-mail or organisation contains ``text``, ignoring case.

    ``%`` and ``_`` in the text act as wildcards unless ``literal`` is set.
    """
    out = live(df)
    if text:
        if literal:
            text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        pattern = f"%{text}%"
        out = out.where(F.col("name").ilike(pattern) | F.col("email").ilike(pattern) | F.col("org").ilike(pattern))
    if country:
        out = out.where(F.col("country") == country)
    verified = F.coalesce("verified", F.lit(False))
    return (
        out.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())
        .limit(limit)
        .select(
            "id", "name", "email", "org", "phone", "country", verified.alias("verified"), "created_at",
            F.when(verified, "✅").otherwise("⏳").alias("verified_icon"),
        )
    )


def filter_contacts(
    df: DataFrame, country: str | None = None, since: Column | None = None, require: Sequence[str] = ("email",)
) -> DataFrame:
    """Live contacts of a country and period with all ``require`` fields filled, newest first."""
    out = live(df)
    if country:
        out = out.where(F.col("country") == country)
    if since is not None:
        out = out.where(F.col("created_at") >= since)
    for name in require:
        out = out.where(F.col(name).isNotNull() & (F.col(name) != ""))
    return out.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())


def by_mail_domain(df: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Contacts whose e-mail belongs to one of the domains, with the folded address."""
    return df.withColumns({"email_lc": F.lower("email"), "email_domain": email_domain("email")}).where(
        F.col("email_domain").isin(*[d.lower() for d in domains])
    )


def country_options(df: DataFrame) -> DataFrame:
    return live(df).where(F.col("country").isNotNull()).select("country").distinct().orderBy("country")


def recent_jobs(df: DataFrame, keywords: Column, n: int = 20) -> DataFrame:
    """Newest live jobs with a status icon, a shortened URL and the first three keywords."""
    extra = F.size("_kw") - 3
    shown = F.concat(
        F.array_join(F.slice("_kw", 1, 3), ", "),
        F.when(extra > 0, F.concat(F.lit(" (+"), extra.cast("string"), F.lit(")"))).otherwise(""),
    )
    icon = (  # fixed values: what is shown for each status
        F.when(F.col("status") == "done", "✅")
        .when(F.col("status") == "failed", "❌")
        .when(F.col("status") == "in_progress", "⚡")
        .otherwise("⏳")
    )
    return (
        live(df)
        .orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())
        .limit(n)
        .withColumn("_kw", keywords)
        .select(
            "id", "status", icon.alias("status_icon"),
            F.concat(F.substring("url", 1, 50), F.lit("...")).alias("url_short"),
            F.when(F.size("_kw") > 0, shown).otherwise("—").alias("keywords_display"),
            "match_mode", "created_at", "updated_at",
        )
    )


def due_jobs(df: DataFrame, as_of) -> DataFrame:
    """Pending live jobs whose retry time is unset or reached."""
    return live(df).where(
        (F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= at(as_of)))
    )


def claim(df: DataFrame, as_of, slots: int = 3, running: int = 0) -> DataFrame:
    """The next jobs to start: as many as there are free slots."""
    return (
        due_jobs(df, as_of)
        .orderBy(
            F.col("priority").asc_nulls_last(), F.col("retry_count").asc_nulls_last(),
            F.col("created_at").asc_nulls_last(), "id",
        )
        .limit(max(slots - running, 0))
    )


def available_sessions(df: DataFrame, as_of) -> DataFrame:
    """Active, live, unexpired sessions; valid ones first, then the latest used."""
    return (
        live(df)
        .where(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > at(as_of))))
        .withColumn("status_rank", F.when(F.col("validation_status") == "valid", 1).otherwise(3))
        .orderBy("status_rank", F.col("last_used_at").desc_nulls_last(), F.col("created_at").desc_nulls_first(), "id")
    )


def session_verdict(df: DataFrame, as_of) -> DataFrame:
    """Whether each session can be used, and the first reason against it."""
    reason = (
        F.when(~F.coalesce("active", F.lit(False)), "inactive")
        .when(F.coalesce("type", F.lit("storage_state")) != "storage_state", "wrong_type")
        .when(F.col("expires_at") < at(as_of), "expired")
        .when(F.col("validation_status") == "invalid", "invalid")
        .when(F.coalesce("file_path", F.lit("")) == "", "no_path")
    )
    return df.select("id", "domain", reason.isNull().alias("usable"), reason.alias("reason"))


def revisit_due(seen: DataFrame, as_of, hours: int = 168) -> DataFrame:
    """URLs whose last visit is at least ``hours`` old."""
    due = F.col("last_seen_at") + F.make_dt_interval(hours=F.lit(hours))
    return seen.withColumn("next_revisit_after", due).where(F.col("next_revisit_after") <= at(as_of))


def rerun_due(queue: DataFrame, as_of) -> DataFrame:
    """Live finished jobs whose minimum pause since the last run is over."""
    due = F.col("last_run_at") + F.make_dt_interval(hours=F.coalesce("min_rerun_hours", F.lit(168)))
    return live(queue).withColumn("rerun_at", due).where((F.col("status") == "done") & (F.col("rerun_at") <= at(as_of)))


def text_search(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """Contacts whose name, organisation and e-mail together contain every word."""
    text = F.lower(F.concat_ws(" ", "name", "org", "email"))
    tokens = F.split(text, "[^\\p{L}\\p{N}@._-]+")
    wanted = F.array(*[F.lit(w.lower()) for w in words]).cast("array<string>")
    return df.where(F.size(F.array_except(wanted, tokens)) == 0)  # without a lambda: one over both sides of a join is pushed to one of them


def topk_country(contacts: DataFrame, as_of, hours: int = 24, k: int = 10) -> DataFrame:
    """Countries with the most new contacts in the last hours."""
    since = at(as_of) - F.make_dt_interval(hours=F.lit(hours))
    return (
        contacts.where((F.col("created_at") > since) & (F.col("created_at") <= at(as_of)) & F.col("country").isNotNull())
        .groupBy("country")
        .agg(F.count(F.lit(1)).alias("new_contacts"))
        .orderBy(F.desc("new_contacts"), "country")
        .limit(k)
    )


def days_before(as_of, days: int) -> Column:
    return at(as_of) - F.make_dt_interval(days=F.lit(days))


def retain(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows that are not older than ``days``."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= days_before(as_of, days)))


def expired_rows(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    return df.where(F.col(ts) < days_before(as_of, days))


def finished_before(days: int, as_of) -> Column:
    return F.coalesce(
        F.col("status").isin("done", "failed")
        & (F.col("updated_at") < days_before(as_of, days))
        & F.col("deleted_at").isNull(),
        F.lit(False),
    )


def retain_jobs(df: DataFrame, days: int, as_of, hard: bool = False) -> DataFrame:
    """Soft-delete, or drop, finished jobs that have not changed for ``days``."""
    old = finished_before(days, as_of)
    if hard:
        return df.where(~old)
    return df.withColumn("deleted_at", F.when(old, at(as_of)).otherwise(F.col("deleted_at")))


def retention_report(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows to be removed per table."""
    report = None
    for name, removed in parts.items():
        row = removed.agg(F.count(F.lit(1)).alias("deleted_rows")).select(F.lit(name).alias("table_name"), "deleted_rows")
        report = row if report is None else report.unionByName(row)
    return report
