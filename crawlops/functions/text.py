"""Text expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD_BREAK = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``fn``, also inside array lambdas."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def squeeze(c: Column | str) -> Column:
    return F.regexp_replace(col(c), WORD_BREAK, " ")


def text_clean(c: Column | str) -> Column:
    """Drop tags, collapse white space, drop unprintable characters."""
    out = squeeze(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " "))
    return strip(F.regexp_replace(out, "[^\\x{20}-\\x{7E}\\x{A0}-\\x{FFFF}]", ""))


def field_clean(c: Column | str, limit: int = 255) -> Column:
    """Trim, collapse spaces, keep letters, digits and ``_ @ . -``; NULL below two characters."""
    kept = F.regexp_replace(squeeze(strip(c)), "[^\\p{L}\\p{N}_ @.-]", "")
    kept = F.when(F.length(kept) > limit, strip(F.substring(kept, 1, limit))).otherwise(kept)
    return F.when(F.length(kept) >= 2, kept)


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.coalesce(col(c), F.lit("")), 256)


NAMED = json.dumps({name: chr(code) for name, code in name2codepoint.items() if name != "amp"})
# Form of a character reference.
REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});"


def decode_entities(c: Column) -> Column:
    """Named and numeric character references; the ampersand last, so that nothing is decoded twice."""
    known = F.from_json(F.lit(NAMED), "map<string,string>")  # folded to a constant

    def decode(text: Column, name: Column) -> Column:
        number = F.when(
            F.lower(name).startswith("#x"), F.conv(F.substr(name, F.lit(3)), 16, 10)
        ).otherwise(F.substr(name, F.lit(2))).try_cast("int")
        by_number = F.when(
            number.between(1, 0x10FFFF) & (number != 38), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        )
        char = F.when(name.startswith("#"), by_number).otherwise(F.try_element_at(known, name))
        return F.when(char.isNull(), text).otherwise(F.replace(text, F.concat(F.lit("&"), name, F.lit(";")), char))

    def names(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)))

    decoded = let(c, lambda x: F.when(F.contains(x, F.lit("&")), F.aggregate(names(x), x, decode)).otherwise(x))
    for amp in ("&#38;", "&#x26;", "&amp;"):
        decoded = F.replace(decoded, F.lit(amp), F.lit("&"))
    return decoded


# One character that stands for any markup between two text nodes.
BREAK = "\u0001"


def page_text(html: Column | str, limit: int | None = None) -> Column:
    """Visible text nodes, then title, description and keywords: each trimmed, joined by one space.

    The title text also occurs in the visible part.  The whole text is returned
    unless ``limit`` is given.
    """
    html = col(html)
    body = F.regexp_replace(html, HIDDEN, BREAK)
    body = F.regexp_replace(body, "(?s)<!--.*?-->|<[^>]*>", BREAK)
    title = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title", 1)
    nodes = F.transform(F.split(decode_entities(body), BREAK), strip)
    others = [strip(decode_entities(p)) for p in (title, meta(html, "description"), meta(html, "keywords"))]
    text = F.array_join(F.filter(F.concat(nodes, F.array(*others)), lambda node: node != ""), " ")
    text = F.coalesce(text, F.lit(""))
    return F.substring(text, 1, limit) if limit else text


# Elements whose text is not shown.
HIDDEN = "(?is)<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>"


def meta(html: Column, name: str) -> Column:
    """Content of the first meta element of that name."""
    tag = F.regexp_extract(html, f"(?is)<meta\\s[^>]*?name\\s*=\\s*[\"']{name}[\"'][^>]*>", 0)
    quoted = [F.regexp_extract(tag, f"(?is)content\\s*=\\s*{q}([^{q}]*){q}", 1) for q in ('"', "'")]
    return F.concat(*quoted)


def items_from_log(c: Column | str) -> Column:
    """Last "scraped N items" count of a run output, 0 without one."""
    found = F.regexp_extract_all(col(c), F.lit("(?i)scraped (\\d+) items"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("int"), F.lit(0))


# Fixed value: addresses of private networks and of the machine itself.
PRIVATE_ADDRESS = r"^(192\.168\..*|10\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|127\..*)$"


def private_ip(c: Column | str) -> Column:
    """Address in a private or loopback range."""
    return F.coalesce(col(c).rlike(PRIVATE_ADDRESS), F.lit(False))


def session_json_valid(c: Column | str) -> Column:
    """JSON object with cookies or origins, where cookies is a list."""
    text = col(c)
    data = F.try_parse_json(text)
    keys = F.when(data.isNotNull(), F.json_object_keys(text))
    cookies = F.schema_of_variant(F.try_variant_get(data, "$.cookies", "variant"))
    has_cookies = F.array_contains(keys, "cookies")
    good = (has_cookies | F.array_contains(keys, "origins")) & (~has_cookies | F.coalesce(cookies.startswith("ARRAY"), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def error_category(status: Column | str, message: Column | str, error: Column | str | None = None, rules=None) -> Column:
    """Status class first, then the first rule whose text occurs, else ``unknown``."""
    status = col(status)
    text = F.lower(F.coalesce(col(message), F.lit("")))
    if error is not None:
        text = F.concat(text, F.lit(" "), F.lower(F.coalesce(col(error), F.lit(""))))
    out = F.when((status >= 500) & (status < 600), "http_5xx").when((status >= 400) & (status < 500), "http_4xx")
    for needle, category in rules or ERROR_RULES:
        out = out.when(text.contains(needle.lower()), category)
    return out.otherwise("unknown")


# Message text and its category, first match wins.
ERROR_RULES = [
    ("timeout", "timeout"),
    ("proxy", "proxy"),
    ("ssl", "network"),
    ("connection refused", "network"),
    ("dns", "network"),
    ("captcha", "anti_bot"),
]
