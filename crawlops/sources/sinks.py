"""CSV, e-mail list and snapshot sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlops.session import at


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_emails(df: DataFrame, path: str) -> None:
    """One address per line."""
    df.select("email").dropna().write.mode("overwrite").text(path)


def refresh_snapshot(df: DataFrame, path: str, as_of, seq: int = 0) -> str:
    """Write a new version of a stored view, then point readers to it and log the refresh.

    Readers follow the newest pointer, so they see the old version until the new one is whole.
    ``seq`` orders refreshes with the same reference time.
    """
    spark = df.sparkSession
    version = f"{path}/versions/{uuid.uuid4().hex}"
    df.write.parquet(version)
    entry = spark.range(1).select(
        F.lit(version).alias("version"), at(as_of).alias("refreshed_at"), F.lit(seq).cast("bigint").alias("seq"), F.lit("INFO").alias("level"),
        F.lit("maintenance").alias("component"), F.lit("snapshot refreshed").alias("message"),
    )
    entry.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Newest version of a stored view."""
    newest = spark.read.parquet(f"{path}/log").agg(F.max_by("version", F.struct("refreshed_at", "seq"))).first()[0]
    return spark.read.parquet(newest)
