"""Rule tables: input and expected output worked out by hand, and the standard library as judge for URLs."""

import random
from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from crawlops.functions import contact, lang, text, urls
from crawlops.functions.sql import register_functions
from crawlops.operators.proxies import parse_proxy_lines


def apply(spark, expr, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


CASES = [
    (contact.email_valid, ["A.b@acme.org", "a@b", "latest@acme.org", "x@example.com", " a@acme.org ", None, "noreply@acme.org"],
     [True, False, False, False, True, False, False]),
    (contact.name_from_email, ["jean.dupont12@x.org", "info@x.org", "a.b@x.org", "j.martin.paul@x.org", "nothing", None],
     ["Jean Dupont", None, None, "Martin Paul", None, None]),
    (text.field_clean, ["  Dr  É! ", "x", "y" * 300, "+33 (1) 2", None, "a  b"], ["Dr É", None, "y" * 255, "33 1 2", None, "a b"]),
    (urls.url_normalize, ["HTTP://A.com", "http://a.com/p?b=2&a=1&c=#x", "", None, "example.com/x", "http://a.com/p;v=1?q=a+b%7E*"],
     ["http://a.com/", "http://a.com/p?a=1&b=2&c=", "", None, None, "http://a.com/p?q=a+b~%2A"]),
    (lang.lang_spider, ["il est la bas", "the cat", "x y z", "", None, "x the y"], ["fr", None, "es", None, None, "en"]),
    (lambda c: F.array_join(contact.phones(c), "|"), ["1234567", "12345678", "1" * 15, "1" * 16 + " x", "+33 1 23 45 67 89 x"],
     ["", "12345678", "1" * 15, "", "+33 1 23 45 67 89"]),
    (lambda c: text.error_category(F.lit(None).cast("int"), c), ["Proxy timeout", "boom", "proxy 407", "DNS", None],
     ["timeout", "unknown", "proxy", "network", "unknown"]),
    (lambda c: urls.link_allowed(c, F.lit("a.org")),
     ["http://b.org/", "http://a.org/x.PDF", "mailto:a@a.org", "http://a.org/#a", "http://a.org/contact"],
     [False, False, False, False, True]),
    (text.items_from_log, ["Scraped 3 items, scraped 12 items", "none", None], [12, 0, 0]),
    (text.private_ip, ["10.1.2.3", "172.15.0.1", "172.16.0.1", "8.8.8.8", None], [True, False, True, False, False]),
    (contact.name_valid, ["Jo", "Jean Dupont", "Jean de Mar", "Jean 2", None], [False, True, False, False, False]),
    (contact.name_guess, ["xx Marie Dubois", "Al Bo", None], ["Marie Dubois", None, None]),
    (text.session_json_valid, ['{"cookies":[]}', '{"cookies":{}}', '{"origins":[]}', "[]", "{", None], [True, False, True, False, False, False]),
    (lambda c: F.array_join(lang.keywords(c), "|"), ['[" Law ", 5, "x", "Visa"]', "a, BB;cc\ndd", "", None], ["law|visa", "bb|cc|dd", "", ""]),
    (lambda c: F.array_join(lang.keywords_form(c), "|"), [" A, b ;;C ", None], ["A|b|C", ""]),
    (text.text_clean, ["<b>a</b>\n\tb\u0007 ", None], ["a b", ""]),
    (urls.item_url, ["http://a.org/x", "a.org/x", None], ["http://a.org/x", None, None]),
]


@pytest.mark.parametrize(("expr", "values", "wanted"), CASES)
def test_rule(spark, expr, values, wanted):
    assert apply(spark, expr, values) == wanted


def test_status_decides_first(spark):
    df = spark.createDataFrame([(404, "timeout"), (503, "x"), (200, "ssl")], "s int, m string")
    assert [r[0] for r in df.select(text.error_category("s", "m")).collect()] == ["http_4xx", "http_5xx", "network"]


def test_keyword_modes(spark):
    rows = [
        ("contact law", ["law", "visa"], "any", 1, True), ("contact law", ["law", "visa"], "multiple", 2, False),
        ("lawyer visa", ["law", "visa"], "all", 1, True), ("x", [], "all", 0, False), ("law", ["law", "law"], "multiple", 2, True),
    ]
    df = spark.createDataFrame(rows, "t string, w array<string>, m string, n int, wanted boolean")
    out = df.select("wanted", lang.keyword_match("t", "w", "m", "n").alias("k")).collect()
    assert all(r.wanted == r.k.matches for r in out)


def test_confidence(spark):
    rows = [(0, 2, "a@acme.org", "other.org", 0.5), (1, 2, "a@acme.org", "other.org", 0.65), (2, 2, "a@acme.org", "www.acme.org", 1.0)]
    df = spark.createDataFrame(rows, "f int, n int, e string, s string, wanted double")
    for r in df.select("wanted", contact.confidence(F.col("f"), F.col("n"), F.col("e"), F.col("s")).alias("c")).collect():
        assert abs(r.wanted - r.c) < 1e-9


def test_name_org_phone_near(spark):
    page = "blah Contact: Marie Dubois, Dubois Consulting, marie@acme.org +33 1 23 45 67 89 and more"
    df = spark.createDataFrame([("marie@acme.org", page)], "e string, t string")
    near = df.select(contact.name_org_near("e", "t").alias("n"), contact.phone_near("e", "t", contact.phones("t")).alias("p")).first()
    assert near.n.name == "Marie Dubois"
    assert near.n.org.endswith("Dubois Consulting")
    assert near.p == "+33 1 23 45 67 89"


def test_page_text(spark):
    html = (
        "<html><head><title> Cabinet &amp; Co </title><meta content='Un cabinet &eacute;tabli' name='description'>"
        '<meta name="keywords" content="law, visa"><script>var x = "<p>no</p>";</script><style>p{}</style></head>'
        "<body><p> One\n two </p><!-- hidden --><noscript>off</noscript><div></div>caf&#233; &#xE9; &amp;lt; &unknown;</body></html>"
    )
    wanted = "Cabinet & Co One\n two café é &lt; &unknown; Cabinet & Co Un cabinet établi law, visa"
    assert apply(spark, text.page_text, [html, "", None]) == [wanted, "", ""]
    assert apply(spark, lambda c: text.page_text(c, 7), [html]) == ["Cabinet"]


BASES = ["http://a.org/b/c/d?q=1", "https://a.org", "http://a.org/b/", "http://a.org/b/c.html#top"]
HREFS = ["x", "./x", "../x", "../../x", "../../../x", "/x/./y/../z", "//h.org/p", "?q=2", "#f", "", "http://o.org/x", "mailto:a@b.org", ".", "..",
         "a/b/../../c?x=1#y", "/a//b", "x/", "../"]


def test_join_like_the_standard_library(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(pairs, "b string, h string")
    for r in df.select("b", "h", urls.url_join("b", "h").alias("u")).collect():
        assert r.u == urljoin(r.b, r.h), (r.b, r.h)


def normalized(url):
    p = urlparse(url)
    query = urlencode(sorted(parse_qsl(p.query, keep_blank_values=True)))
    return urlunparse((p.scheme.lower() or "http", p.netloc.lower(), p.path or "/", "", query, ""))


def test_normalize_like_the_standard_library(spark):
    given = [
        "HTTPS://Www.A.org:80/P/Q?z=1&a=%C3%A9&a=0&b#x", "http://a.org?x=a%20b&y=c+d", "http://a.org/p;v=2/q;w=1?a=1", "http://a.org/?&&a=",
        "http://u:p@a.org/~x?k=a/b&k=~*", "//a.org/x", "http://a.org/x?y=1=2",
    ]
    assert apply(spark, urls.url_normalize, given) == [normalized(u) for u in given]


def test_many_made_up_urls(spark):
    rng = random.Random(11)
    piece = ["a", "b", "Z", "é", "%41", "%C3%A9", "+", "~", "*", ".", "-", "=", "x=1", "&", ";", "/", "%20", "1"]

    def some(n):
        return "".join(rng.choice(piece) for _ in range(rng.randrange(n)))

    given = [
        rng.choice(["http://", "HTTPS://", "//", "ftp://"]) + rng.choice(["a.org", "B.Org:80", "u@h"]) + rng.choice(["", "/"]) * 1
        + (("/" + some(6).replace("&", "")) if rng.random() < 0.7 else "") + (("?" + some(12)) if rng.random() < 0.8 else "")
        + rng.choice(["", "#f?x"])
        for _ in range(800)
    ]
    ours = apply(spark, urls.url_normalize, given)
    assert [(u, o) for u, o in zip(given, ours, strict=True) if o != normalized(u)] == []


def test_many_made_up_links(spark):
    rng = random.Random(12)
    part = ["a", "..", ".", "b.html", "c", "", "x;y"]
    pairs = [
        (
            rng.choice(["http://a.org", "http://a.org/x/y/z", "https://a.org/p/?q=1", "http://a.org/./m/../n"]),
            rng.choice(["", "/"]) + "/".join(rng.choice(part) for _ in range(rng.randrange(1, 6))) + rng.choice(["", "?k=v", "#f", "/"]),
        )
        for _ in range(800)
    ]
    df = spark.createDataFrame(pairs, "b string, h string")
    found = df.select("b", "h", urls.url_join("b", "h").alias("u")).collect()
    assert [(r.b, r.h, r.u, urljoin(r.b, r.h)) for r in found if r.u != urljoin(r.b, r.h)] == []


def test_proxy_lines(spark):
    lines = ["1.2.3.4:80", "1.2.3.4:80:u:p", "http://h:1", "https://u:p@h:2", "socks5://u:p@h:3", "nonsense", "h:70000", "ftp://h:1", "u:p@h:1"]
    out = parse_proxy_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.valid for r in out] == [True] * 5 + [False] * 4
    assert (out[1].username, out[1].password, out[4].scheme, out[3].username) == ("u", "p", "socks5", "u")


def test_sql_functions_agree(spark, tables):
    names = register_functions(spark)
    assert "url_normalize" in names
    same = [
        (tables.contact_items, "email", "email_valid(email)", contact.email_valid("email")),
        (tables.contact_items, "org", "field_clean(org, 12)", text.field_clean("org", 12)),
        (tables.raw_urls, "raw", "url_normalize(raw)", urls.url_normalize("raw")),
        (tables.raw_urls, "raw", "url_domain(raw)", urls.url_domain("raw")),
        (tables.raw_urls, "raw", "url_valid(raw)", urls.url_valid("raw")),
        (tables.raw_urls, "url", "link_allowed(raw, url_domain(url))", urls.link_allowed("raw", urls.url_domain("url"))),
        (tables.corpus, "text", "array_join(page_emails(text), ' ')", F.array_join(contact.emails("text"), " ")),
        (tables.corpus, "text", "array_join(page_phones(text), ' ')", F.array_join(contact.phones("text"), " ")),
        (tables.corpus, "text", "name_guess(text)", contact.name_guess("text")),
        (tables.corpus, "text", "text_clean(text)", text.text_clean("text")),
        (tables.corpus, "text", "lang_detect(text)", lang.lang_spider("text")),
        (tables.corpus, "text", "content_hash(text)", text.content_hash("text")),
        (tables.corpus, "text", "name_valid(substring(text, 1, 20))", contact.name_valid(F.substring("text", 1, 20))),
        (tables.contact_items, "email", "name_from_email(email)", contact.name_from_email("email")),
        (tables.corpus, "text", "array_join(text_emails(text), ' ')", F.array_join(contact.emails_util("text"), " ")),
        (tables.corpus, "text", "array_join(text_phones(text), ' ')", F.array_join(contact.phones_util("text"), " ")),
        (tables.queue, "custom_keywords", "array_join(keywords_form(custom_keywords), '|')", F.array_join(lang.keywords_form("custom_keywords"), "|")),
        (tables.contact_items, "email", "contact_hash(email, name, org)", contact.contact_hash("email", "name", "org")),
        (tables.proxy_results, "message", "error_category(status_code, message)", text.error_category("status_code", "message")),
    ]
    for df, _, sql, column in same:
        differing = df.select(F.expr(sql).alias("a"), column.alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
        assert differing.isEmpty(), sql
