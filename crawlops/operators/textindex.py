"""Stored posting lists: which rows hold a word or three letters in a row."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
BREAK = "[^\\p{L}\\p{N}@._-]+"
APART = "\x00"  # between fields: no three letters of a search run over it
GRAM = 3
LEAST_ROWS, MOST_ROWS = 10_000, 100_000  # whose terms one task sorts: the least worth a task, and the most beyond two tasks a core


def words_of(fields: Sequence[str]) -> Column:
    """Distinct words of several columns, in small letters."""
    return F.array_distinct(F.split(F.lower(F.concat_ws(" ", *fields)), BREAK))


def grams_of(fields: Sequence[str]) -> Column:
    """Distinct runs of three characters within the columns, in small letters."""
    text = F.lower(F.concat_ws(APART, *fields))
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM))))


@dataclass(frozen=True)
class TextIndex:
    """Posting lists in ``folder``: a folder for each bucket of terms, files sorted by term."""

    spark: SparkSession
    folder: str
    id_col: str = "id"
    buckets: int = BUCKETS

    def build(self, df: DataFrame, terms: Column) -> TextIndex:
        """Store who holds each term.  The rows are dealt out before their terms are made, and each part sorts its own terms:
        a bucket has a file of each part, and so has a term of very many rows."""
        n = df.count()
        parts = max(1, min(-(-n // LEAST_ROWS), max(2 * self.spark.sparkContext.defaultParallelism, -(-n // MOST_ROWS))))
        rows = df.repartition(parts, self.id_col).select(F.col(self.id_col).alias("id"), F.explode(terms).alias("term")).where("term <> ''")
        placed = rows.withColumn("bucket", self._bucket(F.col("term")))
        placed.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(self.folder)
        return self

    def holding(self, terms: Sequence[str]) -> DataFrame:
        """``id`` of the rows that hold all terms; only the buckets of these terms are read."""
        wanted = sorted(set(terms))
        if not wanted:
            raise ValueError("no term to look up")
        at = self.spark.range(1).select(F.array(*[self._bucket(F.lit(t)) for t in wanted])).first()[0]
        lists = self.spark.read.schema("id bigint, term string, bucket int").parquet(self.folder)
        found = lists.where(F.col("bucket").isin(sorted(set(at))) & F.col("term").isin(wanted))
        return found.groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select(F.col("id").alias(self.id_col))

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def text_search(df: DataFrame, index: TextIndex, words: Sequence[str]) -> DataFrame:
    """Rows that hold every word, by an index of ``words_of``; all rows if there is no word."""
    return df.join(index.holding([w.lower() for w in words]), index.id_col, "left_semi") if words else df


def may_contain(df: DataFrame, index: TextIndex, text: str, literal: bool = False) -> DataFrame:
    """Rows that may hold ``text``, by an index of ``grams_of``; all rows if the text has no three letters in a row.

    ``%`` and ``_`` stand for any letters unless ``literal`` is set; so does what a backslash makes literal.
    """
    parts = [text] if literal else re.split(r"[%_\\]", text)
    grams = [p[i : i + GRAM] for p in (part.lower() for part in parts) for i in range(len(p) - GRAM + 1)]
    return df.join(index.holding(grams), index.id_col, "left_semi") if grams else df
