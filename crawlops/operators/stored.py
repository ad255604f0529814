"""Tables stored in buckets of their key, so that merging a batch does not move them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from crawlops.session import scratch


def save_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, name: str = "bucketed", path: str | None = None) -> DataFrame:
    """Store a table in buckets by ``keys``, one sorted file for each, and read it back.

    A join or aggregation on these keys takes the buckets as they lie: only the other side is shuffled,
    into as many parts.  Without ``path`` the files lie in the shared folder.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path or scratch(spark, table)).saveAsTable(table)
    return spark.table(table)


def dealt_as(batch: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """A batch in the buckets of a stored table: it is grouped and joined there without another shuffle."""
    return batch.repartition(buckets, *keys)
