"""The expressions as SQL functions: scalar ones, and those that give rows.

``register_functions(spark)`` lets SQL users call ``url_normalize(u)``,
``email_valid(e)`` and so on.  The bodies are plain SQL, so the optimizer sees
through them; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from crawlops.functions import contact, lang, text, urls
from crawlops.plans import frontier


def raw(pattern: str) -> str:
    return f"r'{pattern}'"


def quoted(pattern: str) -> str:
    """A pattern that holds quotes, as an ordinary SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def chars(value: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in value) + "'"


def _list(words) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in words) + ")"


def _spider() -> str:
    score = {
        k: "(" + " + ".join(f"CAST(contains(t, ' {w} ') AS INT)" for w in ws) + ")" for k, ws in lang.LANGUAGE_WORDS.items()
    }
    best = f"greatest({', '.join(score.values())})"
    cases = " ".join(f"WHEN {s} = {best} THEN '{k}'" for k, s in score.items())
    return f"CASE WHEN {best} <= 0 THEN NULL {cases} END"


def _category() -> str:
    rules = " ".join(f"WHEN contains(lower(message), '{needle}') THEN '{c}'" for needle, c in text.ERROR_RULES)
    return f"CASE WHEN status >= 500 AND status < 600 THEN 'http_5xx' WHEN status >= 400 AND status < 500 THEN 'http_4xx' {rules} ELSE 'unknown' END"


ENDINGS = "(" + "|".join(e.replace(".", r"\.") for e in urls.SKIPPED_ENDINGS) + ")$"

# name, parameters, result type, body; a body may call the functions above it
FUNCTIONS = [
    ("strip_spaces", "x STRING", "STRING", f"btrim(x, {chars(text.SPACES)})"),
    ("squeeze_spaces", "x STRING", "STRING", f"regexp_replace(x, {raw(text.WORD_BREAK)}, ' ')"),
    ("text_clean", "x STRING", "STRING",
     r"strip_spaces(regexp_replace(squeeze_spaces(regexp_replace(coalesce(x, ''), '<[^>]+>', ' ')), r'[^\x{20}-\x{7E}\x{A0}-\x{FFFF}]', ''))"),
    ("field_kept", "x STRING", "STRING", r"regexp_replace(squeeze_spaces(strip_spaces(x)), r'[^\p{L}\p{N}_ @.-]', '')"),
    ("field_cut", "x STRING, n INT", "STRING",
     "CASE WHEN length(field_kept(x)) > n THEN strip_spaces(substring(field_kept(x), 1, n)) ELSE field_kept(x) END"),
    ("field_clean", "x STRING, n INT", "STRING", "CASE WHEN length(field_cut(x, n)) >= 2 THEN field_cut(x, n) END"),
    ("content_hash", "x STRING", "STRING", "sha2(coalesce(x, ''), 256)"),
    ("email_valid", "x STRING", "BOOLEAN",
     f"coalesce(strip_spaces(x) RLIKE {raw(contact.EMAIL_VALID)} AND NOT lower(x) RLIKE {raw(contact.EMAIL_SUSPICIOUS)}, false)"),
    ("email_domain", "x STRING", "STRING", "lower(split_part(x, '@', 2))"),
    ("page_emails", "x STRING", "ARRAY<STRING>", f"array_distinct(regexp_extract_all(x, {raw(contact.unicode(contact.EMAIL_IN_PAGE))}, 0))"),
    ("text_emails", "x STRING", "ARRAY<STRING>", f"array_distinct(regexp_extract_all(coalesce(x, ''), {raw(contact.EMAIL_ANYWHERE)}, 0))"),
    ("text_phones", "x STRING", "ARRAY<STRING>",
     f"array_distinct(regexp_extract_all(coalesce(x, ''), {raw(contact.unicode(contact.PHONE_INTERNATIONAL))}, 0))"),
    ("local_words", "x STRING", "STRING",
     "trim(regexp_replace(regexp_replace(split_part(x, '@', 1), '[._+-]+', ' '), '[0-9]+', ''))"),
    ("words_as_name", "x STRING", "STRING",
     "array_join(transform(filter(split(x, ' +'), w -> length(w) > 1), w -> initcap(w)), ' ')"),
    ("name_from_email", "x STRING", "STRING",
     r"CASE WHEN contains(x, '@') AND length(local_words(x)) >= 2 AND replace(local_words(x), ' ', '') RLIKE r'^\p{L}+$' "
     "AND length(words_as_name(local_words(x))) >= 3 AND contains(words_as_name(local_words(x)), ' ') THEN words_as_name(local_words(x)) END"),
    ("keywords_form", "x STRING", "ARRAY<STRING>",
     f"coalesce(filter(transform(split(strip_spaces(x), '[,;\\n]+'), p -> btrim(p, {chars(text.SPACES)})), p -> p <> ''), CAST(array() AS ARRAY<STRING>))"),
    ("page_phones", "x STRING", "ARRAY<STRING>",
     f"array_distinct(filter(transform(regexp_extract_all(x, {raw(contact.unicode(contact.PHONE_IN_PAGE))}, 0), p -> btrim(p, {chars(text.SPACES)})), "
     r"p -> length(regexp_replace(p, r'[^\p{Nd}]', '')) BETWEEN 8 AND 15))"),
    ("name_guess", "x STRING", "STRING",
     f"CASE WHEN regexp_extract(x, {raw(contact.unicode(contact.NAME_IN_TEXT))}, 1) <> '' THEN concat_ws(' ', "
     f"regexp_extract(x, {raw(contact.unicode(contact.NAME_IN_TEXT))}, 1), regexp_extract(x, {raw(contact.unicode(contact.NAME_IN_TEXT))}, 2)) END"),
    ("name_valid", "x STRING", "BOOLEAN",
     r"coalesce(length(x) >= 3 AND NOT arrays_overlap(split(lower(x), r'(?U)\s+'), " + _list(contact.STOP_WORDS) + r") AND NOT x RLIKE r'(?U)\d', false)"),
    ("contact_hash", "email STRING, name STRING, org STRING", "STRING",
     "sha2(concat_ws('\\u001f', coalesce(lower(strip_spaces(email)), ''), coalesce(lower(strip_spaces(name)), ''), coalesce(lower(strip_spaces(org)), '')), 256)"),
    ("lang_of_lower", "t STRING", "STRING", _spider()),
    ("lang_detect", "x STRING", "STRING", "lang_of_lower(lower(coalesce(x, '')))"),
    ("error_category", "status INT, message STRING", "STRING", _category()),
    ("private_ip", "x STRING", "BOOLEAN",
     f"coalesce(x RLIKE {raw(text.PRIVATE_ADDRESS)}, false)"),
    ("items_from_log", "x STRING", "INT", r"coalesce(try_cast(try_element_at(regexp_extract_all(x, r'(?i)scraped (\d+) items', 1), -1) AS INT), 0)"),
    ("url_scheme", "x STRING", "STRING", f"lower(regexp_extract(x, {raw(urls.SCHEME)}, 1))"),
    ("url_domain", "x STRING", "STRING", "regexp_extract(x, r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"),
    ("url_path", "x STRING", "STRING", "regexp_extract(x, r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"),
    ("url_query", "x STRING", "STRING", r"regexp_extract(x, r'^[^?#]*\?([^#]*)', 1)"),
    ("url_valid", "x STRING", "BOOLEAN", f"coalesce(x RLIKE {raw(urls.FORM_URL)}, false)"),
    ("link_allowed", "x STRING, seed_netloc STRING", "BOOLEAN",
     f"coalesce(url_domain(x) = seed_netloc AND NOT lower(x) RLIKE {raw(ENDINGS)} AND NOT lower(x) RLIKE '{'|'.join(urls.SKIPPED_PARTS)}', false)"),
    ("query_sorted", "q STRING", "STRING",
     "array_join(transform(array_sort(transform(filter(split(q, '&'), p -> p <> ''), p -> struct("
     "coalesce(try_url_decode(split_part(p, '=', 1)), replace(split_part(p, '=', 1), '+', ' ')) AS k, "
     "CASE WHEN contains(p, '=') THEN coalesce(try_url_decode(substring(p, instr(p, '=') + 1)), replace(substring(p, instr(p, '=') + 1), '+', ' ')) ELSE '' END AS v))), "
     "s -> concat(replace(replace(url_encode(s.k), '*', '%2A'), '%7E', '~'), '=', replace(replace(url_encode(s.v), '*', '%2A'), '%7E', '~'))), '&')"),
    ("url_of_clean", "u STRING", "STRING",
     "CASE WHEN u = '' THEN '' WHEN url_domain(u) <> '' THEN concat(coalesce(nullif(url_scheme(u), ''), 'http'), '://', lower(url_domain(u)), "
     "coalesce(nullif(regexp_replace(url_path(u), ';[^/]*$', ''), ''), '/'), CASE WHEN query_sorted(url_query(u)) = '' THEN '' ELSE concat('?', query_sorted(url_query(u))) END) END"),
    ("url_normalize", "x STRING", "STRING", r"url_of_clean(translate(ltrim(x), '\t\r\n', ''))"),
]


def body_of(name: str) -> str:
    """A generator can't call SQL functions, so their bodies are put in."""
    return next(f[3] for f in FUNCTIONS if f[0] == name)


# name, parameters, columns, array that gives a row for each entry, what each column takes from it (``pos`` and ``e``)
TABLE_FUNCTIONS = [
    ("page_contacts", "x STRING", "place INT, email STRING, mail_domain STRING", body_of("page_emails"), "pos, e, lower(split_part(e, '@', 2))"),
    ("page_numbers", "x STRING", "place INT, phone STRING", body_of("page_phones"), "pos, e"),
    ("page_anchors", "html STRING", "pos INT, href STRING, label STRING",
     f"transform(regexp_extract_all(html, {quoted(frontier.ANCHOR)}, 0), a -> struct(regexp_extract(a, {quoted(frontier.ANCHOR)}, 1) AS href, "
     f"regexp_extract(a, {quoted(frontier.ANCHOR)}, 2) AS label))", "pos, replace(e.href, '&amp;', '&'), e.label"),
]


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions and give their names.

    Table functions stand in FROM: ``SELECT p.page_id, c.* FROM pages p, LATERAL page_contacts(p.text) c``;
    they become a generator over the page, without a join.
    """
    for name, params, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    for name, params, columns, array, fields in TABLE_FUNCTIONS:
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE({columns}) "
            f"RETURN SELECT {fields} FROM posexplode({array}) AS t(pos, e)"
        )
    return [f[0] for f in FUNCTIONS + TABLE_FUNCTIONS]
