"""Tables stored by day, from which expired days go as folders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlops.session import cut

DAY = "day"


def store_days(df: DataFrame, ts: str, folder: str) -> None:
    """Store a table with a folder for each day of ``ts``; rows without time have one of their own."""
    dealt = df.withColumn(DAY, F.to_date(ts)).repartitionByRange(DAY, ts)  # a large day fills several files
    dealt.write.partitionBy(DAY).parquet(folder)


def read_days(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop(DAY)


def expire_days(spark: SparkSession, folder: str, ts: str, days: int, as_of: str) -> dict[str, list[str]]:
    """Remove rows older than ``days``: whole days as folders, the border day by writing what is left of it.

    Kept days are not touched.  Doing it again changes nothing.  Gives the days ``dropped`` and ``rewritten``.
    """
    limit = dt.datetime.fromisoformat(as_of) - dt.timedelta(days=days)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
    stored = sorted(n.partition("=")[2] for n in names if n.startswith(f"{DAY}=") and n[len(DAY) + 1 :][:4].isdigit())
    border, done = limit.date().isoformat(), {"dropped": [d for d in stored if d < limit.date().isoformat()], "rewritten": []}
    if border in stored:
        rows = spark.read.option("basePath", folder).parquet(f"{folder}/{DAY}={border}")
        old = F.col(ts) < F.lit(limit).cast("timestamp_ntz")
        if not rows.where(old).isEmpty():
            left = cut(rows.where(~old))
            if left.isEmpty():
                done["dropped"].append(border)
            else:
                left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(folder)
                done["rewritten"].append(border)
    for day in done["dropped"]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{DAY}={day}"), True)
    return done
