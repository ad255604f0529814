"""URL expressions after RFC 3986."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlops.functions.text import col, let, strip

# Syntax accepted by the job form.
FORM_URL = (
    r"^(?i)https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,63}\.?|localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
)
# Link endings and link texts that are not followed.
SKIPPED_ENDINGS = [".pdf", ".doc", ".docx", ".jpg", ".png", ".gif", ".zip"]
SKIPPED_PARTS = ["javascript:", "mailto:", "tel:", "#"]

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme_of(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), SCHEME, 1))


def url_domain(c: Column | str) -> Column:
    """Network location as written; empty without one."""
    return F.regexp_extract(col(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path_of(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"^[^?#]*\?([^#]*)", 1)


def url_valid(c: Column | str) -> Column:
    """Syntax of the job form: scheme, host name or address, port, path."""
    return F.coalesce(col(c).rlike(FORM_URL), F.lit(False))


def item_url(c: Column | str, limit: int = 500) -> Column:
    """URL of an item, cut to the column width; NULL without scheme and host."""
    cut = F.substring(strip(c), 1, limit)
    return F.when((scheme_of(cut) != "") & (url_domain(cut) != ""), cut)


def link_allowed(url: Column | str, seed_netloc: Column | str) -> Column:
    """Link on the seed's host that does not lead to a file, script, address or page part."""
    url = col(url)
    lower = F.lower(url)
    endings = "(" + "|".join(e.replace(".", "\\.") for e in SKIPPED_ENDINGS) + ")$"
    parts = "|".join(SKIPPED_PARTS)
    return F.coalesce((url_domain(url) == col(seed_netloc)) & ~lower.rlike(endings) & ~lower.rlike(parts), F.lit(False))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sorted_query(query: Column) -> Column:
    """Query parameters by name and value; empty values stay."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decoded = F.transform(
        pairs,
        lambda p: let(
            F.instr(p, "="),
            lambda i: F.struct(
                _decoded(F.when(i > 0, F.substr(p, F.lit(1), i - 1)).otherwise(p)).alias("k"),
                F.when(i > 0, _decoded(F.substr(p, i + 1, F.length(p)))).otherwise("").alias("v"),
            ),
        ),
    )
    return F.array_join(F.transform(F.array_sort(decoded), lambda s: F.concat(_encoded(s.k), F.lit("="), _encoded(s.v))), "&")


def url_normalize(c: Column | str) -> Column:
    """Folded scheme and host, path at least ``/``, query sorted, no fragment and no path parameters.

    An empty text stays empty; a URL without host gives NULL.
    """
    url = F.translate(F.ltrim(col(c)), "\t\r\n", "")
    host = F.lower(url_domain(url))
    path = F.regexp_replace(path_of(url), ";[^/]*$", "")
    query = query_of(url)
    scheme = F.coalesce(F.nullif(scheme_of(url), F.lit("")), F.lit("http"))
    whole = F.concat(
        scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(
            let(sorted_query(query), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        ),
    )
    return F.when(url == "", "").when(host != "", whole)


def url_join(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link found on the page ``base``."""
    base, href = col(base), strip(F.coalesce(col(href), F.lit("")))
    b_scheme, b_host, b_path = scheme_of(base), url_domain(base), path_of(base)
    path, query, fragment = path_of(href), F.regexp_extract(href, r"^[^#]*?(\?[^#]*)", 1), F.regexp_extract(href, "(#.+)$", 1)
    origin = F.concat(b_scheme, F.lit("://"), b_host)
    b_query = F.regexp_extract(base, r"^[^#]*?(\?[^#]*)", 1)
    folder = F.when(b_path == "", "/").otherwise(F.regexp_replace(b_path, "[^/]*$", ""))
    steps = F.when(path.startswith("/"), F.split(path, "/")).otherwise(
        F.split(F.concat(F.regexp_replace(folder, "/{2,}", "/"), F.regexp_replace(path, "/{2,}", "/")), "/")
    )
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(path.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    resolved = F.when(path.rlike(r"(^|/)\.\.?(/|$)") | folder.rlike(r"/\.\.?/"), F.concat(F.array_join(walked, "/"), closing)).otherwise(
        F.array_join(steps, "/")
    )
    rooted = F.concat(F.when(resolved.startswith("/"), "").otherwise("/"), resolved)
    return (
        F.when(href == "", base)
        .when(scheme_of(href) != "", href)
        .when(url_domain(href) != "", F.concat(b_scheme, F.lit(":"), href))
        .when(path == "", F.concat(origin, b_path, F.when(query == "", b_query).otherwise(query), fragment))
        .otherwise(F.concat(origin, rooted, query, fragment))
    )


def url_keys(c: Column | str) -> Column:
    """Struct of the normalised URL, its hash, domain and path hash."""
    return let(
        url_normalize(c),
        lambda u: F.struct(
            u.alias("normalized_url"), F.sha2(u, 256).alias("url_hash"),
            url_domain(u).alias("domain"), F.sha2(path_of(u), 256).alias("path_hash"),
        ),
    )
