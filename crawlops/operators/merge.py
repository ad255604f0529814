"""Upserts: contacts, seen URLs, proxies and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlops.functions.contact import email_valid, name_from_email
from crawlops.functions.text import field_clean, strip
from crawlops.functions.urls import item_url, url_normalize
from crawlops.operators.once import once
from crawlops.operators.skew import HOT_ROWS, skew_join
from crawlops.session import at

# Column widths of stored contacts.
WIDTHS = {"name": 255, "org": 200, "languages": 50, "phone": 30, "country": 100, "source": 50, "page_lang": 10}
URL_WIDTH = 500


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def clean_items(items: DataFrame) -> DataFrame:
    """Cleaned fields of every item with the verdict valid, invalid_email or no_name."""
    judged = once(items, _mail=strip("email"))
    judged = once(
        judged, _name=F.coalesce(field_clean("name", WIDTHS["name"]), name_from_email("_mail")), _valid=email_valid("_mail")
    )
    source = field_clean(F.coalesce(_has(items, "source"), F.lit("Scraper")), WIDTHS["source"])
    extra = [c for c in ("confidence_score", "extraction_method", "weight") if c in items.columns]
    return judged.select(
        "item_id", "seen_at", "query_id",
        F.when(~F.col("_valid"), "invalid_email").when(F.col("_name").isNull(), "no_name").otherwise("valid").alias("verdict"),
        F.lower("_mail").alias("email"), F.col("_name").alias("name"),
        *[field_clean(_has(items, c), WIDTHS[c]).alias(c) for c in ("org", "languages", "phone", "country", "page_lang")],
        source.alias("source"), item_url("url", URL_WIDTH).alias("url"),
        F.nullif(F.substring(strip(_has(items, "seed_url")), 1, URL_WIDTH), F.lit("")).alias("seed_url"),
        *extra,
    )


# Contact fields by merge rule.
LATEST = ["org", "phone", "country", "url", "languages", "query_id", "seed_url"]
FIRST = ["source", "page_lang"]
BEST = ["confidence_score", "extraction_method"]


def fold_items(items: DataFrame) -> DataFrame:
    """One row per e-mail: first of the longest names, last filled value of the other fields.

    An item with a ``weight`` counts as so many.  Plain aggregates, so rows are combined before the shuffle and one e-mail may
    hold any share of them.
    """
    order = F.struct("seen_at", "item_id")

    def earliest(value: Column) -> Column:
        return F.min_by(value, order)

    def latest(name: str) -> Column:
        filled = F.col(name).isNotNull() if name == "query_id" else F.coalesce(F.col(name), F.lit("")) != ""
        return F.max_by(F.col(name), F.when(filled, order))

    first_longest = F.min_by("name", F.struct(-F.length(F.coalesce("name", F.lit(""))), order))
    aggs = [first_longest.alias("name")]
    aggs += [latest(c).alias(c) for c in LATEST if c in items.columns]
    aggs += [earliest(F.col(c)).alias(c) for c in FIRST if c in items.columns]
    aggs += [F.max(c).alias(c) for c in BEST if c in items.columns]
    aggs += [(F.sum("weight") if "weight" in items.columns else F.count(F.lit(1))).alias("items"), F.min("seen_at").alias("first_seen_at")]
    return items.groupBy("email").agg(*aggs)


def merge_contacts(base: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """Contacts after a batch of valid cleaned items, with what happened to each row.

    Live contacts are unique by e-mail; deleted ones take no part and stay as they
    are.  ``action`` is insert, update or keep.
    """
    new = fold_items(items)
    n = {c: F.col(f"_n.{c}") for c in new.columns}
    old = {c: F.col(f"_o.{c}") for c in base.columns}
    is_new = n["email"].isNotNull()
    is_old = ~is_new | old["email"].isNotNull()

    def merged(name: str) -> Column:
        if name == "email":
            return F.coalesce(n["email"], old["email"])
        if name == "name":
            longer = F.length(F.coalesce(n["name"], F.lit(""))) > F.length(F.coalesce(old["name"], F.lit("")))
            return F.when(longer, n["name"]).otherwise(old["name"])
        if name == "created_at":
            return F.when(is_old, old["created_at"]).otherwise(at(as_of))
        if name == "updated_at":
            return F.when(is_new, at(as_of)).otherwise(old["updated_at"])
        if name in LATEST and name in n:
            return F.coalesce(n[name], old[name])
        if name in FIRST + BEST and name in n:
            return F.when(is_old, old[name]).otherwise(n[name])
        return old[name]

    columns = list(base.columns) + [c for c in LATEST + FIRST + BEST if c in n and c not in old]
    for c in columns:
        old.setdefault(c, F.lit(None))
    if "updated_at" not in columns:
        columns.append("updated_at")
        old["updated_at"] = F.lit(None).cast("timestamp_ntz")
    action = F.when(~is_old, "insert").when(is_new, "update").otherwise("keep")
    same = (F.col("_o.email") == F.col("_n.email")) & F.col("_o.deleted_at").isNull()
    return base.alias("_o").join(new.alias("_n"), same, "full_outer").select(
        *[merged(c).alias(c) for c in columns],
        action.alias("action"),
        F.coalesce(n["items"], F.lit(0)).alias("items"),
    )


def latest_per_email(df: DataFrame) -> DataFrame:
    """Newest row of each e-mail, taken by aggregation so that crowded e-mails are no burden."""
    row = F.struct(*df.columns)
    newest = F.max_by(row, F.struct(F.col("created_at").isNull(), "created_at", "id"))
    return df.groupBy(F.col("email").alias("_key")).agg(newest.alias("_row")).select("_row.*")


def scope(job_id: str = "job_id") -> Column:
    """Job id as text; jobs 0 and NULL share the global scope."""
    return F.when(F.coalesce(F.col(job_id), F.lit(0)) == 0, "global").otherwise(F.col(job_id).cast("string"))


def unseen(candidates: DataFrame, seen: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Candidates whose normalised URL was not seen in the same scope."""
    keyed = candidates.withColumns({"scope": scope(), "normalized_url": url_normalize("url")})
    known = seen.select(scope().alias("scope"), url_normalize("url").alias("normalized_url")).distinct()
    return skew_join(keyed, known, ["scope", "normalized_url"], "left_anti", hot_rows)


SEEN_MERGED = ("url", "normalized_url", "first_seen_at", "last_seen_at", "visit_count")


def merge_seen(base: DataFrame, batch: DataFrame) -> DataFrame:
    """URL store after a batch of visits: first and last time, number of visits.

    ``base`` has url, normalized_url, first_seen_at, last_seen_at, visit_count and keeps its
    other columns, which are null for new URLs; ``batch`` has url and visited_at.
    """
    visits = batch.groupBy("url").agg(
        F.min("visited_at").alias("first_seen_at"), F.max("visited_at").alias("last_seen_at"),
        F.count(F.lit(1)).alias("visit_count"),
    )
    o, n = base.alias("o"), visits.alias("n")
    url = F.coalesce("o.url", "n.url")
    return o.join(n, F.col("o.url") == F.col("n.url"), "full_outer").select(
        url.alias("url"),
        F.coalesce("o.normalized_url", url_normalize(F.col("n.url"))).alias("normalized_url"),
        F.coalesce("o.first_seen_at", "n.first_seen_at").alias("first_seen_at"),
        F.greatest("o.last_seen_at", "n.last_seen_at").alias("last_seen_at"),
        (F.coalesce("o.visit_count", F.lit(0)) + F.coalesce("n.visit_count", F.lit(0))).alias("visit_count"),
        *[F.col(f"o.{c}") for c in base.columns if c not in SEEN_MERGED],
    )


PROXY_KEY = ["scheme", "host", "port", "username"]


def merge_proxies(base: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Insert proxies or take over ``active`` on (scheme, host, port, user name or none).

    ``new`` has a column ``ord``; the last row of a key decides its state.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("username", F.coalesce("username", F.lit("")))

    last = keyed(new).groupBy(*PROXY_KEY).agg(
        F.max_by("active", "ord").alias("new_active"), F.min_by("password", "ord").alias("new_password")
    )
    found = F.col("new_active").isNotNull()
    rest = [c for c in base.columns if c not in (*PROXY_KEY, "active", "password", "created_at", "updated_at")]
    updated = F.col("updated_at") if "updated_at" in base.columns else F.lit(None)
    stored = keyed(base).withColumn("_stored", F.lit(True))
    return stored.join(last, PROXY_KEY, "full_outer").select(
        *rest, "scheme", "host", "port", F.nullif("username", F.lit("")).alias("username"),
        F.when(F.col("_stored"), F.col("password")).otherwise(F.col("new_password")).alias("password"),
        F.coalesce("new_active", "active").alias("active"),
        F.when(F.col("_stored"), F.col("created_at")).otherwise(at(as_of)).alias("created_at"),
        F.when(found, at(as_of)).otherwise(updated).alias("updated_at"),
    )


def merge_settings(base: DataFrame, new: DataFrame, mode: str = "nothing", as_of=None) -> DataFrame:
    """Insert-if-absent (``nothing``) or insert-or-replace (``replace``) by key."""
    if mode == "nothing":
        return base.unionByName(new.join(base, "key", "left_anti"))
    o, n = base.alias("o"), new.alias("n")
    cols = [F.coalesce("o.key", "n.key").alias("key")]
    cols += [
        F.when(F.col("n.key").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in base.columns if c != "key"
    ]
    return o.join(n, F.col("o.key") == F.col("n.key"), "full_outer").select(*cols)


def typed_settings(df: DataFrame) -> DataFrame:
    """Value in the column of its declared type; NULL when it does not parse."""
    value, kind = F.col("value"), F.col("value_type")

    def when_kind(name: str, parsed: Column) -> Column:
        return F.when(kind == name, parsed)

    return df.select(
        "key", "value", "value_type",
        when_kind("string", value).alias("string_value"),
        when_kind("integer", value.try_cast("bigint")).alias("integer_value"),
        when_kind("float", value.try_cast("double")).alias("float_value"),
        when_kind("boolean", value.try_cast("boolean")).alias("boolean_value"),
        when_kind("json", F.when(F.try_parse_json(value).isNotNull(), value)).alias("json_value"),
    )


def stamp_updated(df: DataFrame, changes: dict[str, str], as_of) -> DataFrame:
    """Take over new values and stamp ``updated_at`` on the rows where one differs."""
    differs = F.lit(False)
    for old, new in changes.items():
        differs = differs | ~F.col(old).eqNullSafe(F.col(new))
    return df.withColumn("updated_at", F.when(differs, at(as_of)).otherwise(F.col("updated_at"))).withColumns(
        {old: F.col(new) for old, new in changes.items()}
    ).drop(*changes.values())
