"""Configuration and text files, written from the given tables and read by the loaders."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crawlops.catalog.functions import LINE
from crawlops.catalog.registry import query
from crawlops.functions import lang
from crawlops.functions.text import error_category
from crawlops.operators.once import once
from crawlops.session import scratch
from crawlops.sources import readers

# Markers of a language are its ten most frequent words, its themes the next two times six.
WORDS = "split(lower(text), '[^\\\\p{L}]+')"
PARTS = {"marker": (1, 10), "first": (11, 16), "second": (17, 22)}


def config_file(t) -> str:
    """Language configuration of the documents: a few words for each of their languages."""
    words = t.documents.select("lang", F.explode(F.expr(WORDS)).alias("word")).where("length(word) > 1")
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("place", place).where("place <= 22").orderBy("lang", "place").collect()
    config: dict = {"language_markers": {}, "keywords": {}}
    for row in top:
        if row["place"] <= 10:
            config["language_markers"].setdefault(row["lang"], []).append(row["word"] + " ")
        else:
            theme = "first" if row["place"] <= 16 else "second"
            config["keywords"].setdefault(row["lang"], {}).setdefault(theme, []).append(row["word"])
    return text_file(t, "languages", [json.dumps(config, ensure_ascii=False)])


def text_file(t, name: str, lines: list[str]) -> str:
    path = scratch(t.spark, name)
    t.spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def dims(t):
    return readers.load_lang_dims(t.spark, config_file(t))


TOP = """w AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM documents),
n AS (SELECT lang, word, count(*) AS n FROM w WHERE length(word) > 1 GROUP BY 1, 2),
p AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM n),
d AS (SELECT doc_id, lower(text) AS t FROM documents)"""


@query("src_lang_file", f"""
WITH {TOP} SELECT lang, CASE WHEN place <= 10 THEN 'marker' ELSE 'theme' END AS kind, CASE WHEN place <= 10 THEN NULL WHEN place <= 16 THEN 'first' ELSE 'second' END AS term_group,
  CASE WHEN place <= 10 THEN word || ' ' ELSE word END AS term, CAST(CASE WHEN place <= 10 THEN place - 1 WHEN place <= 16 THEN place - 11 ELSE place - 17 END AS INTEGER) AS ord
FROM p WHERE place <= 22""")
def _(t):
    return dims(t)


@query("lang_detect_configured", f"""
WITH {TOP}, c AS (SELECT doc_id, lang, sum((length(t) - length(replace(t, word || ' ', ''))) / length(word || ' ')) AS s FROM d, p WHERE place <= 10 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS k FROM c)
SELECT doc_id, CASE WHEN s > 0 THEN lang END AS detected FROM r WHERE k = 1""")
def _(t):
    return t.documents.select("doc_id", lang.lang_markers("text", readers.markers_of(dims(t))).alias("detected"))


@query("lang_supported_configured", "SELECT id, coalesce(lang_filter IN (SELECT lang FROM documents), FALSE) AS ok FROM queue ")
def _(t):
    return t.queue.select("id", lang.lang_supported("lang_filter", readers.markers_of(dims(t))).alias("ok"))


@query("theme_tags_configured", f"""
WITH {TOP}, h AS (SELECT doc_id, lang, CASE WHEN place <= 16 THEN 'first' ELSE 'second' END AS theme, CAST(sum(CASE WHEN contains(t, word) THEN 1 ELSE 0 END) AS INTEGER) AS hits
  FROM d, p WHERE place BETWEEN 11 AND 22 GROUP BY ALL) SELECT doc_id, lang, theme, hits FROM h WHERE hits >= 2""")
def _(t):
    tagged = once(t.documents.select("doc_id", "text"), h=lang.theme_hits("text", readers.themes_of(dims(t))))
    return tagged.select("doc_id", F.explode("h").alias("h")).where("h.hits >= 2").select("doc_id", "h.lang", "h.theme", "h.hits")


@query("error_category_configured", """
WITH n AS (SELECT DISTINCT lower(split_part(message, ' ', 1)) AS needle FROM proxy_results WHERE message IS NOT NULL)
SELECT event_id, CASE WHEN status_code BETWEEN 500 AND 599 THEN 'http_5xx' WHEN status_code BETWEEN 400 AND 499 THEN 'http_4xx'
  ELSE coalesce((SELECT 'about ' || min(needle) FROM n WHERE contains(lower(coalesce(message, '')), needle)), 'unknown') END AS category FROM proxy_results """)
def _(t):
    found = t.proxy_results.where("message IS NOT NULL").select(F.lower(F.split("message", " ")[0]).alias("needle"))
    needles = [r["needle"] for r in found.distinct().orderBy("needle").collect()]
    path = text_file(t, "errors", [json.dumps({"contains": {n: f"about {n}" for n in needles}})])
    rules = readers.load_error_rules(t.spark, path)
    return t.proxy_results.select("event_id", error_category("status_code", "message", rules=rules).alias("category"))


VALID = "s_suppkey % 8 IN (0, 1, 2, 3) AND CASE WHEN s_suppkey % 8 = 0 THEN 8000 + s_suppkey <= 65535 ELSE TRUE END"


@query("src_proxy_file", f"SELECT trim({LINE}) AS line, {VALID} AS valid, CASE WHEN {VALID} THEN CASE WHEN s_suppkey % 8 = 3 THEN 'https' ELSE 'http' END END AS scheme FROM supplier")
def _(t):
    path = scratch(t.spark, "proxies")
    t.supplier.select(F.expr(LINE).alias("value")).write.text(path)
    return readers.read_proxy_lines(t.spark, path).select("line", "valid", F.when(F.col("valid"), F.col("scheme")).alias("scheme"))


@query("src_copy_file", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_name || chr(9) || 'x\\y' END AS name, c_acctbal AS balance, c_custkey % 2 = 0 AS active FROM customer""")
def _(t):
    fields = [
        F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 > 0, F.concat("c_name", F.lit("\\tx\\\\y"))).otherwise("\\N"),
        F.col("c_acctbal").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "t").otherwise("f"),
    ]
    path = scratch(t.spark, "copy")
    t.customer.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return readers.read_copy(t.spark, path, StructType.fromDDL("id bigint, name string, balance double, active boolean"))
