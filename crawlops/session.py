"""Session helpers: explicit reference time, scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import datetime as dt
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("crawlops")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", own_folder())
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def at(as_of: str | dt.datetime | Column) -> Column:
    """Reference time as a zone-less timestamp column."""
    if isinstance(as_of, Column):
        return as_of
    text = as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; differences of two of them are exact."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


@functools.cache
def own_folder() -> str:
    """Temporary folder of a local session; it goes when the process ends."""
    made = tempfile.mkdtemp(prefix="crawlops-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a session in one process
    without that setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.conf.set("spark.checkpoint.dir", own_folder())
    return own_folder()


def scratch(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Store the rows in the shared folder and restart the lineage there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
