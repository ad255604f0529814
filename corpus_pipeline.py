"""Pipeline over documents: toxicity, SimHash near-dedup, secret scans, best-fit packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlops.llm.packing import pack_documents
from crawlops.llm.secret_scan import redacted
from crawlops.llm.simhash_dedup import MAX_BITS, SHINGLE, fingerprint_of, near_duplicates
from crawlops.llm.toxicity import THRESHOLD, fit, toxic_score
from crawlops.session import scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
CACHED = 100_000  # words a worker keeps while packing; it has run three other stages before
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, unchanged."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxic_score("text", model, spark) < THRESHOLD)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id, unchanged.

    Null ids come last.  Of repeated rows, and of rows that share id and fingerprint, one stays.
    """
    place, columns, keys = scratch(spark, "fingerprints"), docs.columns, ["key", "no_key", "fp"]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    docs.select(row, fingerprint_of(F.col("text"), SHINGLE).alias("fp")).write.parquet(place)  # each text is hashed once
    stored = spark.read.parquet(place)
    found = near_duplicates(stored.select("row.doc_id", "fp"), SHINGLE, MAX_BITS, fp_col="fp")
    first = F.struct(F.col("doc_id").isNull().alias("no_key"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("key"), "fp")
    kept = found.groupBy("root").agg(F.min(first).alias("k")).select("k.key", "k.no_key", "k.fp")
    id_, none = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(0)), F.col("row.doc_id").isNull()
    rows = stored.select("row", id_.alias("key"), none.alias("no_key"), "fp")
    one = Window.partitionBy(*keys).orderBy("row.text")  # as the join has dealt the rows out
    single = rows.join(kept, keys).withColumn("place", F.row_number().over(one)).where("place = 1")
    return single.select(*[F.col("row").getField(c).alias(c) for c in columns])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret; ``n_chars`` follows the text."""
    clean = redacted("text", BYTE_RANKS, public_tokenizers.PATTERN)
    changed = docs.withColumn("text", clean)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return pack_documents(docs, WORD_BPE, cached=CACHED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_clean),
    ("near_dedup", keep_one_of_group),
    ("secrets", without_secrets),
    ("packing", packed),
]

# Training a model, hashing shingles and tokenizing can't be said in SQL; tests compare with loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one stored in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        place = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
