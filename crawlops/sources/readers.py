"""Table, page, configuration and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlops.functions.lang import DEFAULT_MARKERS


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Stored table with its declared schema."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """Table of a database, read in ``parts`` ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawl responses that succeeded; a table without status holds only such pages."""
    return ok_pages(spark.read.parquet(path))


def ok_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status") == 200) if "status" in pages.columns else pages


def load_lang_dims(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Configured terms as rows (lang, kind, term_group, term, ord); built-in markers without a file."""
    if path is None:
        rows = [(lang, "marker", None, term, i) for lang, words in DEFAULT_MARKERS.items() for i, term in enumerate(words)]
        return spark.createDataFrame(rows, "lang string, kind string, term_group string, term string, ord int")
    words = "array<string>"
    schema = (
        f"language_markers map<string,{words}>, keywords map<string,map<string,{words}>>, "
        f"specialization_keywords map<string,map<string,{words}>>, quality_indicators map<string,{words}>, "
        f"exclusion_patterns map<string,{words}>"
    )
    raw = spark.read.schema(schema).json(path, multiLine=True)

    def flat(column: str, kind: str) -> DataFrame:
        return raw.select(F.explode(column).alias("a", "words")).select(
            F.when(F.lit(kind == "marker"), F.col("a")).alias("lang"), F.lit(kind).alias("kind"),
            F.when(F.lit(kind != "marker"), F.col("a")).alias("term_group"), F.posexplode("words").alias("ord", "term"),
        )

    def nested(column: str, kind: str, lang_first: bool) -> DataFrame:
        pairs = raw.select(F.explode(column).alias("a", "inner")).select("a", F.explode("inner").alias("b", "words"))
        lang, group = ("a", "b") if lang_first else ("b", "a")
        return pairs.select(
            F.col(lang).alias("lang"), F.lit(kind).alias("kind"), F.col(group).alias("term_group"),
            F.posexplode("words").alias("ord", "term"),
        )

    out = flat("language_markers", "marker")
    for part in (
        nested("keywords", "theme", True), nested("specialization_keywords", "specialisation", False),
        flat("quality_indicators", "quality"), flat("exclusion_patterns", "exclusion"),
    ):
        out = out.unionByName(part)
    return out.select("lang", "kind", "term_group", "term", "ord")


def markers_of(dims: DataFrame) -> dict[str, list[str]]:
    """Markers per language as a plain dictionary; the configuration is one small file."""
    rows = dims.where("kind = 'marker'").orderBy("lang", "ord").select("lang", "term").toLocalIterator()
    out: dict[str, list[str]] = {}
    for row in rows:
        out.setdefault(row.lang, []).append(row.term)
    return out


def themes_of(dims: DataFrame) -> dict[str, dict[str, list[str]]]:
    """Words per language and theme as a plain dictionary."""
    rows = dims.where("kind = 'theme'").orderBy("lang", "term_group", "ord").select("lang", "term_group", "term").toLocalIterator()
    out: dict[str, dict[str, list[str]]] = {}
    for row in rows:
        out.setdefault(row.lang, {}).setdefault(row.term_group, []).append(row.term)
    return out


def load_countries(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("countries array<string>").json(path, multiLine=True)
    return sorted_distinct(raw.select(F.explode("countries").alias("country")))


def sorted_distinct(df: DataFrame) -> DataFrame:
    return df.where(F.col("country").isNotNull()).distinct().orderBy("country")


def load_error_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Rules in file order, ready for ``error_category``."""
    raw = spark.read.schema("contains map<string,string>").json(path, multiLine=True)
    row = raw.select(F.map_entries("contains").alias("rules")).first()
    return [(r["key"], r["value"]) for r in (row.rules or [])] if row else []


def read_copy(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    r"""Rows of a COPY text block: tab-separated, ``\N`` for NULL, backslash escapes.

    Lines are split by the engine; a field keeps its escapes until it is decoded here.
    """
    lines = spark.read.text(path).where(~F.col("value").isin("\\.", ""))
    return copy_fields(lines, schema)


def copy_fields(lines: DataFrame, schema: T.StructType) -> DataFrame:
    fields = F.split("value", "\t", -1)
    cols = []
    for i, field in enumerate(schema.fields):
        raw = F.get(fields, F.lit(i))
        mark = "\u0000"
        text = F.replace(raw, F.lit("\\\\"), F.lit(mark))
        for escape, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            text = F.replace(text, F.lit(escape), F.lit(char))
        text = F.when(raw != "\\N", F.replace(text, F.lit(mark), F.lit("\\")))
        if isinstance(field.dataType, T.BooleanType):
            value = F.when(text == "t", True).when(text == "f", False)
        elif isinstance(field.dataType, T.StringType):
            value = text
        else:
            value = text.try_cast(field.dataType)
        cols.append(value.alias(field.name))
    return lines.select(*cols)


def read_proxy_lines(spark: SparkSession, path: str) -> DataFrame:
    from crawlops.operators.proxies import parse_proxy_lines

    return parse_proxy_lines(spark.read.text(path).where(F.trim("value") != ""))
