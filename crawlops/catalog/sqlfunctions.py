"""The registered SQL functions, each against the SQL that checks its column expression."""

from __future__ import annotations

from crawlops.catalog import functions
from crawlops.catalog.functions import q, sql_list
from crawlops.catalog.joins import ANCHORS
from crawlops.catalog.registry import ORACLES, query
from crawlops.functions import contact, urls
from crawlops.functions.sql import register_functions
from crawlops.plans import frontier

# query it is checked by: (table, columns in SQL)
CALLS = {
    "url_normalize": ("raw_urls", ["page_id", "url_normalize(raw) AS normalized"]),
    "url_domain": ("raw_urls", ["page_id", "url_domain(raw) AS domain"]),
    "url_valid_form": ("raw_urls", ["page_id", "url_valid(raw) AS ok"]),
    "email_valid": ("contact_items", ["item_id", "email_valid(email) AS ok"]),
    "name_from_email": ("contact_items", ["item_id", "name_from_email(email) AS name"]),
    "contact_hash": ("contact_items", ["item_id", "contact_hash(email, name, org) AS contact_hash"]),
    "name_valid": ("documents", ["doc_id", "name_valid(text) AS ok"]),
    "lang_detect_spider": ("documents", ["doc_id", "lang_detect(text) AS detected"]),
    "error_category": ("proxy_results", ["event_id", "error_category(status_code, message) AS category"]),
    "private_ip": ("events", ["event_id", f"private_ip({functions.ADDRESS}) AS private"]),
    "content_hash": ("documents", ["doc_id", "content_hash(CASE WHEN doc_id % 9 > 0 THEN text END) AS content_hash"]),
    "text_clean": ("documents", ["doc_id", f"text_clean({functions.TAGGED}) AS text"]),
    "field_clean": (
        "contact_items",
        ["item_id", "field_clean(name, 255) AS name", "field_clean(org, 12) AS org", "field_clean(phone, 30) AS phone",
         "field_clean(substring(concat('é! ', name), 1, 2), 255) AS short"],
    ),
    "emails_spider": ("corpus", ["doc_id", "array_join(page_emails(text), '|') AS emails"]),
    "emails_util": ("corpus", ["doc_id", "array_join(text_emails(text), '|') AS emails"]),
    "phones_spider": ("corpus", ["doc_id", "array_join(page_phones(text), '|') AS phones"]),
    "phones_util": ("corpus", ["doc_id", "array_join(text_phones(text), '|') AS phones"]),
    "name_guess": ("corpus", ["doc_id", "name_guess(text) AS name"]),
    "keywords_parse_form": (
        "queue", ["id", "array_join(keywords_form(" + functions.FORM_WORDS.replace("chr(10)", "'\\n'") + "), '|') AS keywords"],
    ),
    "items_from_log": ("events", ["event_id", f"items_from_log({functions.LOG}) AS items"]),
}


def call(name: str):
    table, columns = CALLS[name]

    def run(t):
        register_functions(t.spark)
        return getattr(t, table).selectExpr(*columns)

    return run


for _name in CALLS:
    query(f"sql_{_name}")(call(_name))
    ORACLES[f"sql_{_name}"] = ORACLES[_name]


# helpers that have no column expression of their own, with the patterns spelled out
PARTS = r"""
SELECT page_id, lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  regexp_extract(raw, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(raw, '^[^?#]*\?([^#]*)', 1) AS query FROM raw_urls """


@query("sql_url_parts", PARTS)
def _(t):
    register_functions(t.spark)
    return t.raw_urls.selectExpr("page_id", "url_scheme(raw) AS scheme", "url_path(raw) AS path", "url_query(raw) AS query")


@query("sql_link_allowed")
def _(t):
    register_functions(t.spark)
    links = t.raw_urls.withColumn("link", urls.url_join("url", "href"))
    return links.selectExpr("page_id", "link_allowed(link, url_domain(url)) AS ok")


def rows_of(t, table: str, sql: str):
    register_functions(t.spark)
    return t.spark.sql(sql, source=getattr(t, table))


EACH = "SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS place, unnest(a) AS {0} FROM ({1})"
MAILS = sql_list("emails", contact.EMAIL_IN_PAGE, "corpus").replace("array_to_string(a, '|') AS emails", "a")


@query("sql_page_contacts", f"SELECT *, lower(split_part(email, '@', 2)) AS mail_domain FROM ({EACH.format('email', MAILS)})")
def _(t):
    return rows_of(t, "corpus", "SELECT p.doc_id, c.* FROM {source} p, LATERAL page_contacts(p.text) c")


@query("sql_page_numbers", EACH.format("phone", f"SELECT doc_id, a FROM {functions.PHONES}"))
def _(t):
    return rows_of(t, "corpus", "SELECT p.doc_id, n.* FROM {source} p, LATERAL page_numbers(p.text) n")


@query("sql_page_anchors", f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href, label FROM (SELECT page_id, {ANCHORS.format(p=q(frontier.ANCHOR))} FROM pages)")
def _(t):
    return rows_of(t, "pages", "SELECT p.page_id, a.* FROM {source} p, LATERAL page_anchors(p.html) a")


ORACLES["sql_link_allowed"] = ORACLES["link_allowed"]
