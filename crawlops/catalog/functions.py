"""Scalar expressions applied to whole tables, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlops.catalog.registry import query
from crawlops.functions import contact, lang, text, urls
from crawlops.sources.readers import copy_fields
from crawlops.operators.once import once
from crawlops.operators.proxies import parse_proxy_lines, proxy_client, proxy_uri

WS = text.SPACES
WB = text.WORD_BREAK


def q(s: str) -> str:
    """SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {q(WS)})"


def sql_squeeze(x: str) -> str:
    return f"regexp_replace({x}, {q(WB)}, ' ', 'g')"


def sql_field(x: str, n: int) -> str:
    kept = f"regexp_replace({sql_squeeze(sql_strip(x))}, '[^\\p{{L}}\\p{{N}}_ @.-]', '', 'g')"
    cut = f"CASE WHEN length({kept}) > {n} THEN {sql_strip(f'substring({kept}, 1, {n})')} ELSE {kept} END"
    return f"CASE WHEN length({cut}) >= 2 THEN {cut} END"


def sql_entities(x: str) -> str:
    for name, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, {q(name)}, {q(char)})"
    return x


def sql_piece(x: str) -> str:
    return f"nullif({sql_strip(sql_entities(x))}, '')"


BODY = f"regexp_replace(regexp_replace(html, {q(text.HIDDEN)}, chr(1), 'g'), '(?s)<!--.*?-->|<[^>]*>', chr(1), 'g')"
NODES = f"array_to_string(list_filter(list_transform(string_split({sql_entities(BODY)}, chr(1)), lambda n: {sql_strip('n')}), lambda n: n <> ''), ' ')"
PAGE_TEXT = f"""concat_ws(' ', nullif({NODES}, ''), {sql_piece("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")},
  {sql_piece("regexp_extract(regexp_extract(html, '(?is)<meta\\s[^>]*name=\"description\"[^>]*>'), 'content=\"([^\"]*)\"', 1)")})"""


@query("page_text", f"SELECT page_id, {PAGE_TEXT} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", text.page_text("html").alias("text"))


@query("src_pages", "SELECT page_id, url, length(html) AS size FROM pages")
def _(t):
    from crawlops.sources.readers import read_pages

    return read_pages(t.spark, f"{t.sf_dir}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("size"))


TAGGED = "concat('<p class=\"a\">', text, '</p>', chr(7), ' \t end ')"


@query("text_clean", f"""
SELECT doc_id, {sql_strip(f"regexp_replace({sql_squeeze(f'regexp_replace({TAGGED}, {q("<[^>]+>")}, {q(" ")}, {q("g")})')}, '[^\\x{{20}}-\\x{{7E}}\\x{{A0}}-\\x{{FFFF}}]', '', 'g')")} AS text FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.text_clean(F.expr(TAGGED)).alias("text"))


@query("field_clean", f"""
SELECT item_id, {sql_field('name', 255)} AS name, {sql_field('org', 12)} AS org, {sql_field('phone', 30)} AS phone,
  {sql_field("substring(concat('é! ', name), 1, 2)", 255)} AS short FROM contact_items """)
def _(t):
    return t.contact_items.select(
        "item_id", text.field_clean("name").alias("name"), text.field_clean("org", 12).alias("org"),
        text.field_clean("phone", 30).alias("phone"), text.field_clean(F.expr("substring(concat('é! ', name), 1, 2)")).alias("short"),
    )


EV = contact.EMAIL_VALID
ES = contact.EMAIL_SUSPICIOUS


@query("email_valid", f"""
SELECT item_id, coalesce(regexp_matches({sql_strip('email')}, {q(EV)}) AND NOT regexp_matches(lower(email), {q(ES)}), FALSE) AS ok FROM contact_items """)
def _(t):
    return t.contact_items.select("item_id", contact.email_valid("email").alias("ok"))


@query("email_valid_corpus", f"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(contact.EMAIL_ANYWHERE)})) AS email FROM documents)
SELECT doc_id, email, regexp_matches({sql_strip('email')}, {q(EV)}) AND NOT regexp_matches(lower(email), {q(ES)}) AS ok FROM (SELECT DISTINCT * FROM e)""")
def _(t):
    found = t.documents.select("doc_id", F.explode(contact.emails_util("text")).alias("email"))
    return found.select("doc_id", "email", contact.email_valid("email").alias("ok"))


def sql_list(name: str, pattern: str, source: str) -> str:
    """Distinct matches in order, joined."""
    return f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, {q(pattern)}) AS a FROM {source} ),
d AS (SELECT doc_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM m)
SELECT doc_id, array_to_string(a, '|') AS {name} FROM d"""


@query("emails_spider", sql_list("emails", contact.EMAIL_IN_PAGE, "corpus"))
def _(t):
    return t.corpus.select("doc_id", F.array_join(contact.emails("text"), "|").alias("emails"))


@query("emails_util", sql_list("emails", contact.EMAIL_ANYWHERE, "corpus"))
def _(t):
    return t.corpus.select("doc_id", F.array_join(contact.emails_util("text"), "|").alias("emails"))


@query("phones_util", sql_list("phones", contact.PHONE_INTERNATIONAL, "corpus"))
def _(t):
    return t.corpus.select("doc_id", F.array_join(contact.phones_util("text"), "|").alias("phones"))


PHONES = f"""(SELECT doc_id, list_filter(p, lambda x, i: list_position(p, x) = i) AS a FROM (SELECT doc_id,
  list_filter(list_transform(regexp_extract_all(text, {q(contact.PHONE_IN_PAGE)}), lambda x: {sql_strip('x')}),
  lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15) AS p FROM corpus ))"""


@query("phones_spider", f"SELECT doc_id, array_to_string(a, '|') AS phones FROM {PHONES}")
def _(t):
    return t.corpus.select("doc_id", F.array_join(contact.phones("text"), "|").alias("phones"))


@query("ordered_distinct", """
WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS a FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') AS words FROM w""")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


# word boundaries spelled out, as the oracle's own ones know ASCII only
GUESS = "(?:^|[^\\p{L}\\p{N}_])([A-Z][a-z]{2,})\\s+([A-Z][a-z]{2,})(?:$|[^\\p{L}\\p{N}_])"


@query("name_guess", f"""
SELECT doc_id, CASE WHEN regexp_extract(text, {q(GUESS)}, 1) <> '' THEN
  regexp_extract(text, {q(GUESS)}, 1) || ' ' || regexp_extract(text, {q(GUESS)}, 2) END AS name FROM corpus """)
def _(t):
    return t.corpus.select("doc_id", contact.name_guess("text").alias("name"))


@query("name_from_email", """
WITH w AS (SELECT item_id, email, trim(regexp_replace(regexp_replace(split_part(email, '@', 1), '[._+-]+', ' ', 'g'), '[0-9]+', '', 'g')) AS c FROM contact_items ),
n AS (SELECT *, array_to_string(list_transform(list_filter(regexp_split_to_array(c, ' +'), lambda x: length(x) > 1),
  lambda x: upper(x[1]) || lower(substring(x, 2))), ' ') AS n FROM w)
SELECT item_id, CASE WHEN contains(email, '@') AND length(c) >= 2 AND regexp_matches(replace(c, ' ', ''), '^\\p{L}+$') AND length(n) >= 3 AND contains(n, ' ') THEN n END AS name FROM n""")
def _(t):
    return t.contact_items.select("item_id", contact.name_from_email("email").alias("name"))


def sql_around(radius: int) -> str:
    p = "instr(lower(text), lower(email))"
    return f"substring(text, greatest({p} - {radius}, 1), {p} + {radius} - greatest({p} - {radius}, 1))"


def sql_name_valid(x: str) -> str:
    stop = "[" + ", ".join(q(w) for w in contact.STOP_WORDS) + "]"
    return f"(length({x}) >= 3 AND NOT list_has_any(regexp_split_to_array(lower({x}), '\\s+'), {stop}) AND NOT regexp_matches({x}, '\\d'))"


def sql_first(patterns: list[str], ok) -> str:
    found = [sql_strip(f"regexp_extract(c, {q(p)}, 1)") for p in patterns]
    return "coalesce(" + ", ".join(f"CASE WHEN {ok(f)} THEN {f} END" for f in found) + ")"


SQL_NAME = sql_first(contact.NAME_PATTERNS, sql_name_valid)
SQL_ORG = sql_first(contact.ORG_PATTERNS, lambda f: f"length({f}) > 3")
MAIL_IN_CORPUS = f"(SELECT doc_id, text, regexp_extract(text, {q(contact.EMAIL_IN_PAGE)}) AS email FROM corpus )"


def first_mail(t):
    return once(t.corpus.select("doc_id", "text"), email=F.get(contact.emails("text"), F.lit(0)))


@query("name_org_near", f"""
WITH c AS (SELECT doc_id, {sql_around(200)} AS c FROM {MAIL_IN_CORPUS}) SELECT doc_id, {SQL_NAME} AS name, {SQL_ORG} AS org FROM c""")
def _(t):
    near = once(first_mail(t), near=contact.name_org_near("email", "text"))
    return near.select("doc_id", "near.name", "near.org")


@query("name_valid", f"SELECT doc_id, {sql_name_valid('text')} AS ok FROM documents")
def _(t):
    return t.documents.select("doc_id", contact.name_valid("text").alias("ok"))


@query("name_valid_contacts", f"SELECT item_id, coalesce({sql_name_valid('name')}, FALSE) AS ok FROM contact_items ")
def _(t):
    return t.contact_items.select("item_id", contact.name_valid("name").alias("ok"))


@query("phone_near", f"""
WITH c AS (SELECT m.doc_id, {sql_around(300)} AS c, p.a FROM {MAIL_IN_CORPUS} m JOIN {PHONES} p ON m.doc_id = p.doc_id)
SELECT doc_id, list_filter(a, lambda x: contains(c, x))[1] AS phone FROM c""")
def _(t):
    return first_mail(t).select("doc_id", contact.phone_near("email", "text", contact.phones("text")).alias("phone"))


FORM_WORDS = "concat(theme, ', b ;', coalesce(custom_keywords, ''), chr(10), ' X ')"


@query("keywords_parse", f"""
WITH k AS (SELECT id, CASE WHEN custom_keywords LIKE '[%' THEN list_transform(CAST(custom_keywords AS JSON)::VARCHAR[], lambda x: lower({sql_strip('x')}))
  ELSE list_transform(regexp_split_to_array({sql_strip('custom_keywords')}, '[,;\n]+'), lambda x: lower({sql_strip('x')})) END AS a FROM queue )
SELECT id, coalesce(array_to_string(list_filter(a, lambda x: length(x) > 1), '|'), '') AS keywords FROM k""")
def _(t):
    return t.queue.select("id", F.array_join(lang.keywords("custom_keywords"), "|").alias("keywords"))


@query("keywords_parse_form", f"""
WITH k AS (SELECT id, list_transform(regexp_split_to_array({sql_strip(FORM_WORDS)}, '[,;\n]+'), lambda x: {sql_strip('x')}) AS a FROM queue )
SELECT id, array_to_string(list_filter(a, lambda x: x <> ''), '|') AS keywords FROM k""")
def _(t):
    return t.queue.select("id", F.array_join(lang.keywords_form(F.expr(FORM_WORDS.replace("chr(10)", "'\\n'"))), "|").alias("keywords"))


MATCH_SQL = """
WITH k AS (SELECT doc_id, lower(text) AS t, CASE doc_id % 4 WHEN 0 THEN ['the ', 'tion', 'zzz'] WHEN 1 THEN ['con', 'con', 'der'] WHEN 2 THEN ['marie', 'contact'] ELSE CAST([] AS VARCHAR[]) END AS w,
  CASE doc_id % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'multiple' ELSE 'all' END AS m FROM corpus ),
f AS (SELECT doc_id, m, len(w) AS n, list_filter(w, lambda x: contains(t, x)) AS found FROM k)
SELECT doc_id, array_to_string(found, '|') AS found_keywords, CAST(len(found) AS INTEGER) AS match_count,
  n > 0 AND CASE m WHEN 'any' THEN len(found) >= 1 WHEN 'multiple' THEN len(found) >= 2 ELSE len(found) = n END AS matches FROM f"""


@query("keyword_match", MATCH_SQL)
def _(t):
    def words(*ws):
        return F.array(*[F.lit(w) for w in ws]).cast("array<string>")

    kw = (
        F.when(F.col("doc_id") % 4 == 0, words("the ", "tion", "zzz")).when(F.col("doc_id") % 4 == 1, words("con", "con", "der"))
        .when(F.col("doc_id") % 4 == 2, words("marie", "contact")).otherwise(words())
    )
    mode = F.when(F.col("doc_id") % 3 == 0, "any").when(F.col("doc_id") % 3 == 1, "multiple").otherwise("all")
    hit = once(t.corpus, w=kw, m=mode)
    hit = once(hit, hit=lang.keyword_match("text", "w", "m", F.lit(2)))
    return hit.select("doc_id", F.array_join("hit.found_keywords", "|").alias("found_keywords"), "hit.match_count", "hit.matches")


def sql_best(scores: dict[str, str]) -> str:
    best = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {best} <= 0 THEN NULL " + " ".join(f"WHEN {s} = {best} THEN {q(k)}" for k, s in scores.items()) + " END"


SPIDER_SQL = sql_best({k: "(" + " + ".join(f"CAST(contains(t, {q(' ' + w + ' ')}) AS INT)" for w in ws) + ")" for k, ws in lang.LANGUAGE_WORDS.items()})
MARKER_SQL = sql_best(
    {k: "(" + " + ".join(f"(length(t) - length(replace(t, {q(w)}, ''))) // {len(w)}" for w in ws) + ")" for k, ws in lang.DEFAULT_MARKERS.items()}
)


@query("lang_detect_spider", f"WITH l AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, {SPIDER_SQL} AS detected FROM l")
def _(t):
    return t.documents.select("doc_id", lang.lang_spider("text").alias("detected"))


@query("lang_detect_markers", f"WITH l AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, {MARKER_SQL} AS detected FROM l")
def _(t):
    return t.documents.select("doc_id", lang.lang_markers("text").alias("detected"))


@query("lang_supported", "SELECT id, coalesce(lang_filter IN ('fr', 'en', 'es', 'de', 'it'), FALSE) AS ok FROM queue ")
def _(t):
    return t.queue.select("id", lang.lang_supported("lang_filter").alias("ok"))


MARKER_ROWS = ", ".join(f"{{'lang': {q(k)}, 'term': {q(w)}}}" for k, ws in lang.DEFAULT_MARKERS.items() for w in ws)


@query("src_lang_config", f"""
WITH m AS (SELECT unnest([{MARKER_ROWS}]) AS m), d AS (SELECT lang, lower(text) AS t FROM documents)
SELECT m.m.lang AS marker_lang, m.m.term AS term, d.lang AS doc_lang, count(*) AS documents FROM d, m WHERE contains(d.t, m.m.term) GROUP BY ALL""")
def _(t):
    markers = F.array(*[F.struct(F.lit(k).alias("lang"), F.lit(w).alias("term")) for k, ws in lang.DEFAULT_MARKERS.items() for w in ws])
    hits = text.let(F.lower("text"), lambda x: F.filter(markers, lambda m: F.contains(x, m.term)))
    return (
        t.documents.select("lang", F.explode(hits).alias("m"))
        .groupBy(F.col("m.lang").alias("marker_lang"), "m.term", F.col("lang").alias("doc_lang"))
        .agg(F.count(F.lit(1)).alias("documents"))
    )


CONTEXT = {
    "contact_page": contact.CONTACT_WORDS, "team_page": contact.TEAM_WORDS, "about_page": contact.ABOUT_WORDS,
    "professional_context": contact.PROFESSION_WORDS,
}
FLAGS = ", ".join("(" + " OR ".join(f"contains(t, {q(w)})" for w in ws) + f") AS {n}" for n, ws in CONTEXT.items())
SCORE = " + ".join(f"CAST({n} AS INTEGER)" for n in CONTEXT)
DOC_PLUS = "lower(concat(text, CASE doc_id % 3 WHEN 0 THEN ' Notre équipe' WHEN 1 THEN ' About our CLINIC' ELSE '' END))"


@query("contact_context", f"""
WITH l AS (SELECT doc_id, {DOC_PLUS} AS t FROM corpus ), f AS (SELECT doc_id, {FLAGS} FROM l)
SELECT *, {SCORE} AS context_score, {SCORE} > 0 AS has_contact_context FROM f""")
def _(t):
    return once(t.corpus, c=contact.contact_context(F.expr(DOC_PLUS))).select("doc_id", "c.*")


@query("confidence", """
WITH d AS (SELECT item_id, lower(list_last(string_split(email, '@'))) AS a, CASE item_id % 3 WHEN 0 THEN 'www.mail3.acme.org' WHEN 1 THEN 'other.org' ELSE '' END AS b,
  (item_id % 4)::DOUBLE AS f, (item_id % 5)::DOUBLE AS n FROM contact_items )
SELECT item_id, round(least(1.0::DOUBLE, 0.5::DOUBLE + f / greatest(n, 1) * 0.3::DOUBLE + CASE WHEN contains(b, a) OR contains(a, b) THEN 0.2::DOUBLE ELSE 0::DOUBLE END), 6) AS score FROM d""")
def _(t):
    seed = F.when(F.col("item_id") % 3 == 0, "www.mail3.acme.org").when(F.col("item_id") % 3 == 1, "other.org").otherwise("")
    score = contact.confidence(F.col("item_id") % 4, F.col("item_id") % 5, F.col("email"), seed)
    return t.contact_items.select("item_id", F.round(score, 6).alias("score"))


# parameters of the theme query: invented words of the given prose
THEMES = {
    "en": {"trade": ["thing", "ention", "reat", "the on"], "care": ["heed", "ander", "this"]},
    "fr": {"trade": ["eau", "tion", "des "], "care": ["mentre", "elle ", "pour "]},
    "de": {"trade": ["ung", "sch", "der "], "care": ["lich", "nicht"]},
}
THEME_ROWS = ", ".join(
    f"{{'lang': {q(k)}, 'theme': {q(n)}, 'words': [{', '.join(q(w) for w in ws)}]}}" for k, by in THEMES.items() for n, ws in by.items()
)


def sql_present(ws, weight):
    return "(" + " + ".join(f"CAST(contains(t, {q(w)}) AS INT)" for w in ws) + f") * {weight}::DOUBLE"


SPECIAL, QUALITY, EXCLUDED = ["tion", "thing"], ["member", "elle"], ["bot", "der "]


@query("theme_tags", f"""
WITH m AS (SELECT unnest([{THEME_ROWS}]) AS m), d AS (SELECT doc_id, lower(text) AS t FROM documents),
h AS (SELECT doc_id, m.m.lang AS lang, m.m.theme AS theme, CAST(len(list_filter(m.m.words, lambda w: contains(t, w))) AS INTEGER) AS hits,
  {sql_present(SPECIAL, 1.5)} + {sql_present(QUALITY, 1.2)} + {sql_present(EXCLUDED, -2.0)} AS weight FROM d, m)
SELECT doc_id, lang, theme, hits, round(weight, 4) AS weight FROM h WHERE hits >= 2""")
def _(t):
    score = F.round(lang.weighted_score("text", SPECIAL, QUALITY, EXCLUDED), 4)
    tagged = once(t.documents, weight=score).select("doc_id", "weight", F.explode(lang.theme_hits("text", THEMES)).alias("h"))
    return tagged.where("h.hits >= 2").select("doc_id", "h.lang", "h.theme", "h.hits", "weight")


# ------------------------------------------------------------------ URLs

DOMAIN = "regexp_extract({}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
PATH = "regexp_extract({}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
SCHEME = "lower(regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
QUERY = "regexp_extract({}, '^[^?#]*\\?([^#]*)', 1)"


def sql_normalize(u: str) -> str:
    """Normalised URL of a column."""
    pairs = f"list_filter(string_split({QUERY.format(u)}, '&'), lambda p: p <> '')"
    plus = "url_decode(replace({}, '+', ' '))"
    decoded = (
        f"list_sort(list_transform({pairs}, lambda p: {{'k': {plus.format('split_part(p, ' + q('=') + ', 1)')}, "
        f"'v': CASE WHEN contains(p, '=') THEN {plus.format('substring(p, instr(p, ' + q('=') + ') + 1)')} ELSE '' END}}))"
    )
    enc = "replace(url_encode(s.{}), '%20', '+')"
    joined = f"array_to_string(list_transform({decoded}, lambda s: {enc.format('k')} || '=' || {enc.format('v')}), '&')"
    path = f"regexp_replace({PATH.format(u)}, ';[^/]*$', '')"
    return (
        f"CASE WHEN {u} = '' THEN '' WHEN {DOMAIN.format(u)} <> '' THEN coalesce(nullif({SCHEME.format(u)}, ''), 'http') || '://' || "
        f"lower({DOMAIN.format(u)}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN {joined} = '' THEN '' ELSE '?' || {joined} END END"
    )


@query("url_normalize", f"SELECT page_id, {sql_normalize('raw')} AS normalized FROM raw_urls ")
def _(t):
    return t.raw_urls.select("page_id", urls.url_normalize("raw").alias("normalized"))


@query("url_domain", f"SELECT page_id, {DOMAIN.format('raw')} AS domain FROM raw_urls ")
def _(t):
    return t.raw_urls.select("page_id", urls.url_domain("raw").alias("domain"))


def sql_join(b: str, h: str) -> str:
    bq = "regexp_extract({}, '^[^#]*?(\\?[^#]*)', 1)"
    origin = f"{SCHEME.format(b)} || '://' || {DOMAIN.format(b)}"
    folder = f"CASE WHEN {PATH.format(b)} = '' THEN '/' ELSE regexp_replace({PATH.format(b)}, '[^/]*$', '') END"
    p = PATH.format(h)
    full = f"CASE WHEN {p} LIKE '/%' THEN {p} ELSE regexp_replace({folder} || {p}, '/{{2,}}', '/', 'g') END"
    walked = (
        f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split({full}, '/'), lambda x: [x])), "
        "lambda a, s: CASE WHEN s[1] = '..' THEN a[1:len(a) - 1] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END)"
    )
    closing = f"CASE WHEN regexp_matches({p}, '(^|/)\\.\\.?$') THEN '/' ELSE '' END"
    res = f"(array_to_string({walked}, '/') || {closing})"
    return (
        f"CASE WHEN {h} = '' THEN {b} WHEN {SCHEME.format(h)} <> '' THEN {h} WHEN {DOMAIN.format(h)} <> '' THEN {SCHEME.format(b)} || ':' || {h} "
        f"WHEN {p} = '' THEN {origin} || {PATH.format(b)} || CASE WHEN {bq.format(h)} = '' THEN {bq.format(b)} ELSE {bq.format(h)} END || regexp_extract({h}, '(#.+)$', 1) "
        f"ELSE {origin} || CASE WHEN {res} LIKE '/%' THEN '' ELSE '/' END || {res} || {bq.format(h)} || regexp_extract({h}, '(#.+)$', 1) END"
    )


@query("url_absolute", f"SELECT page_id, {sql_join('url', 'href')} AS absolute FROM raw_urls ")
def _(t):
    return t.raw_urls.select("page_id", urls.url_join("url", "href").alias("absolute"))


@query("link_allowed", f"""
WITH a AS (SELECT page_id, url, {sql_join('url', 'href')} AS u FROM raw_urls )
SELECT page_id, {DOMAIN.format('u')} = {DOMAIN.format('url')} AND NOT regexp_matches(lower(u), '(\\.pdf|\\.doc|\\.docx|\\.jpg|\\.png|\\.gif|\\.zip)$')
  AND NOT (contains(lower(u), 'javascript:') OR contains(lower(u), 'mailto:') OR contains(lower(u), 'tel:') OR contains(u, '#')) AS ok FROM a""")
def _(t):
    links = once(t.raw_urls, link=urls.url_join("url", "href"))
    return links.select("page_id", urls.link_allowed("link", urls.url_domain("url")).alias("ok"))


@query("url_valid_form", f"SELECT page_id, coalesce(regexp_matches(raw, {q(urls.FORM_URL)}), FALSE) AS ok FROM raw_urls ")
def _(t):
    return t.raw_urls.select("page_id", urls.url_valid("raw").alias("ok"))


@query("url_valid_item", f"""
WITH c AS (SELECT page_id, substring({sql_strip('raw')}, 1, 30) AS u FROM raw_urls )
SELECT page_id, CASE WHEN {SCHEME.format('u')} <> '' AND {DOMAIN.format('u')} <> '' THEN u END AS url FROM c""")
def _(t):
    return t.raw_urls.select("page_id", urls.item_url("raw", 30).alias("url"))


@query("url_keys", f"""
WITH n AS (SELECT page_id, {sql_normalize('raw')} AS u FROM raw_urls )
SELECT page_id, u AS normalized_url, sha256(u) AS url_hash, {DOMAIN.format('u')} AS domain, sha256({PATH.format('u')}) AS path_hash FROM n""")
def _(t):
    return t.raw_urls.select("page_id", urls.url_keys("raw").alias("k")).select("page_id", "k.*")


@query("content_hash", "SELECT doc_id, sha256(coalesce(CASE WHEN doc_id % 9 > 0 THEN text END, '')) AS content_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", text.content_hash(F.when(F.col("doc_id") % 9 > 0, F.col("text"))).alias("content_hash"))


HASH = f"""sha256(coalesce(lower({sql_strip('email')}), '') || chr(31) || coalesce(lower({sql_strip('name')}), '') || chr(31) || coalesce(lower({sql_strip('org')}), ''))"""


@query("contact_hash", f"SELECT item_id, {HASH} AS contact_hash FROM contact_items ")
def _(t):
    return t.contact_items.select("item_id", contact.contact_hash("email", "name", "org").alias("contact_hash"))


# ------------------------------------------------------------------ other texts


@query("proxy_uri", """
SELECT id, scheme || '://' || CASE WHEN username IS NOT NULL THEN username || ':' || coalesce(password, '') || '@' ELSE '' END || host || ':' || CAST(port AS VARCHAR) AS uri,
  scheme || '://' || host || ':' || CAST(port AS VARCHAR) AS server, username, CASE WHEN username IS NOT NULL THEN coalesce(password, '') END AS password FROM proxies """)
def _(t):
    parts = [F.col(c) for c in ("scheme", "host", "port", "username", "password")]
    return t.proxies.select("id", proxy_uri(*parts).alias("uri"), proxy_client(*parts).alias("c")).select("id", "uri", "c.*")


SESSION_TEXT = """CASE event_id % 8 WHEN 0 THEN '{"cookies":[]}' WHEN 1 THEN '{"origins":1}' WHEN 2 THEN '{"cookies":"[x"}' WHEN 3 THEN '[1]'
  WHEN 4 THEN '{"cookies":null}' WHEN 5 THEN 'bad{' WHEN 6 THEN '{"a":{"cookies":[]}}' ELSE concat('{"cookies":[{"v":', CAST(event_id AS STRING), '}],"x":', props, '}') END"""


@query("session_content_valid", f"""
WITH j AS (SELECT event_id, {SESSION_TEXT} AS j FROM events), v AS (SELECT event_id, CASE WHEN json_valid(j) THEN j END AS j FROM j)
SELECT event_id, coalesce(json_type(j) = 'OBJECT' AND (list_contains(json_keys(j), 'cookies') OR list_contains(json_keys(j), 'origins'))
  AND (NOT list_contains(json_keys(j), 'cookies') OR json_type(j, '$.cookies') = 'ARRAY'), FALSE) AS ok FROM v""")
def _(t):
    return t.events.select("event_id", text.session_json_valid(F.expr(SESSION_TEXT)).alias("ok"))


ADDRESS = "concat(CASE event_id % 6 WHEN 0 THEN '192.168.' WHEN 1 THEN '10.1.' WHEN 2 THEN '172.' WHEN 3 THEN '8.8.' WHEN 4 THEN '127.0.' ELSE '110.1.' END, CAST(user_id AS STRING), '.1.', CAST(event_id % 250 AS STRING))"


@query("private_ip", f"SELECT event_id, regexp_matches({ADDRESS}, '^(192\\.168\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|127\\.)') AS private FROM events")
def _(t):
    return t.events.select("event_id", text.private_ip(F.expr(ADDRESS)).alias("private"))


LOG = "CASE event_id % 3 WHEN 0 THEN 'nothing here' WHEN 1 THEN concat('Scraped ', CAST(user_id AS STRING), ' items') ELSE concat('scraped 1 items ... scraped ', CAST(event_id AS STRING), ' items.') END"


@query("items_from_log", "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN user_id ELSE event_id END AS INTEGER) AS items FROM events")
def _(t):
    return t.events.select("event_id", text.items_from_log(F.expr(LOG)).alias("items"))


@query("json_build", "SELECT level, json_object('deleted_logs', count(*), 'components', list_sort(list(DISTINCT component)))::VARCHAR AS details FROM system_logs GROUP BY 1")
def _(t):
    details = F.to_json(F.struct(F.col("n").alias("deleted_logs"), F.col("c").alias("components")))
    grouped = t.system_logs.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("component")).alias("c"))
    return grouped.select("level", details.alias("details"))


LINE = """CASE s_suppkey % 8 WHEN 0 THEN concat('10.0.0.1:', CAST(8000 + s_suppkey AS STRING)) WHEN 1 THEN concat('10.0.0.1:80:u', CAST(s_suppkey AS STRING), ':pw')
  WHEN 2 THEN concat('http://h', CAST(s_suppkey AS STRING), ':8080') WHEN 3 THEN concat('https://u:p', CAST(s_suppkey AS STRING), '@host:1')
  WHEN 4 THEN ' socks5://u:p@host:70000' WHEN 5 THEN concat('ftp://host:', CAST(s_suppkey AS STRING)) WHEN 6 THEN s_name ELSE concat('u:p@host:', CAST(s_suppkey AS STRING)) END"""


@query("src_proxy_lines", f"""
SELECT s_suppkey AS id, s_suppkey % 8 IN (0, 1, 2, 3) AND CASE WHEN s_suppkey % 8 = 0 THEN 8000 + s_suppkey <= 65535 ELSE TRUE END AS valid,
  CASE s_suppkey % 8 WHEN 0 THEN 'http' WHEN 1 THEN 'http' WHEN 2 THEN 'http' WHEN 3 THEN 'https' END AS scheme,
  CASE s_suppkey % 8 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '10.0.0.1' WHEN 2 THEN 'h' || CAST(s_suppkey AS VARCHAR) WHEN 3 THEN 'host' END AS host,
  CAST(CASE s_suppkey % 8 WHEN 0 THEN 8000 + s_suppkey WHEN 1 THEN 80 WHEN 2 THEN 8080 WHEN 3 THEN 1 END AS INTEGER) AS port,
  CASE s_suppkey % 8 WHEN 1 THEN 'u' || CAST(s_suppkey AS VARCHAR) WHEN 3 THEN 'u' END AS username,
  CASE s_suppkey % 8 WHEN 1 THEN 'pw' WHEN 3 THEN 'p' || CAST(s_suppkey AS VARCHAR) END AS password FROM supplier""")
def _(t):
    lines = t.supplier.select(F.col("s_suppkey").alias("id"), F.expr(LINE).alias("value"))
    parsed = parse_proxy_lines(lines, "id")
    shown = [F.when(F.col("id") % 8 < 4, F.col(c)).alias(c) for c in ("scheme", "host", "port", "username", "password")]
    return parsed.select("id", "valid", *shown)


@query("src_copy_text", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_name || chr(9) || 'x\\y' END AS name, c_acctbal AS balance, c_custkey % 2 = 0 AS active FROM customer""")
def _(t):
    from pyspark.sql.types import StructType

    fields = [
        F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 > 0, F.concat("c_name", F.lit("\\tx\\\\y"))).otherwise("\\N"),
        F.col("c_acctbal").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "t").otherwise("f"),
    ]
    lines = t.customer.select(F.concat_ws("\t", *fields).alias("value"))
    return copy_fields(lines, StructType.fromDDL("id bigint, name string, balance double, active boolean"))
