"""A stored table by key that grows by small runs.

Every change writes one run: the whole rows of the keys that it touches.  A run is a folder of buckets by
a hash of the key; its number of buckets follows its size, so buckets split as the table
grows.  Readers take the newest row of each key over the runs that cover all changes.  When a new run is
at least half as large as the one before, both are merged into one, and so on: a row is
rewritten a logarithmic number of times over the life of the table, and the large old runs stay
as they are.

A run is named after the changes that it covers.  A change that is written again finds the runs before it
unchanged and gives the same rows.  Runs that a later one covers go when the change after it begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BUCKET_ROWS = 1_000_000  # wanted in a bucket
MAX_BUCKETS = 1 << 14
MERGE_AT = 2  # the run before is merged when it is less than so many times as large
NAME = re.compile(r"run=(-?\d+)_(-?\d+)_(\d+)_(\d+)$")  # first and last change, rows, buckets (a power of two)


@dataclass(frozen=True)
class Run:
    path: str
    first: int
    last: int
    rows: int
    buckets: int


class Store:
    """Rows of ``schema`` by ``key`` below ``folder``; rows without a key are not kept."""

    def __init__(self, spark: SparkSession, folder: str, key: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.folder, self.key, self.bucket_rows = spark, folder.rstrip("/"), key, bucket_rows

    def runs(self) -> list[Run]:
        """All whole runs, whether they are covered by others or not."""
        place, fs = self._place(self.folder)
        if not fs.exists(place):
            return []
        found = []
        for status in fs.listStatus(place):
            name = NAME.search(status.getPath().toString())
            if name and fs.exists(self._path(f"{status.getPath().toString()}/_SUCCESS")):
                first, last, rows, buckets = map(int, name.groups())
                found.append(Run(status.getPath().toString(), first, last, rows, buckets))
        return found

    def cover(self, upto: int | None = None) -> list[Run]:
        """Runs that hold every change up to one, oldest first: of those that begin at a change the longest.

        A change without rows leaves no run.
        """
        runs = [r for r in self.runs() if upto is None or r.last <= upto]
        chosen: list[Run] = []
        while later := [r for r in runs if not chosen or r.first > chosen[-1].last]:
            chosen.append(min(later, key=lambda r: (r.first, -r.last)))
        return chosen

    def read(self, upto: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Newest row of each key after the changes up to one; only of ``keys`` if given (one column, distinct)."""
        return self._newest(self.cover(upto), keys)

    def write(self, change: int, rows: DataFrame, expected: int | None = None) -> list[Run]:
        """Store the rows (one for each key) of a change, changes in ascending order; gives the runs written, merged ones last.

        ``rows`` may be read from this table as it was before the change; ``expected`` is about their number, counted if not given.
        """
        self._clear(change)
        rows = rows.where(F.col(self.key).isNotNull())
        before = self.cover(change - 1)
        made = [self._store(rows, change, change, rows.count() if expected is None else expected)]
        group = [made[0]]
        while before and before[-1].rows < MERGE_AT * sum(r.rows for r in group):
            group.insert(0, before.pop())
        if len(group) > 1:
            made.append(self._store(self._newest(group, None), group[0].first, change, sum(r.rows for r in group)))
        return made

    def _clear(self, change: int) -> None:
        """Remove what an earlier attempt at this change left, and runs that others cover since the change before."""
        fs = self._place(self.folder)[1]
        kept = {r.path for r in self.cover(change - 1)}
        for run in self.runs():
            if run.last >= change or run.path not in kept:
                fs.delete(self._path(run.path), True)

    def _store(self, rows: DataFrame, first: int, last: int, expected: int) -> Run:
        """A run is written under another name, as its rows are counted by writing them."""
        seen, draft, buckets = Observation(), f"{self.folder}/_draft_{first}_{last}", self._buckets(expected)
        counted = rows.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("bucket", self._bucket(buckets))
        counted.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(draft)
        n = int(seen.get["n"])
        place, fs = self._place(f"{self.folder}/run={first}_{last}_{n}_{buckets}")
        if not fs.rename(self._path(draft), place):
            raise OSError(f"{place} could not be put in place")
        return Run(fs.makeQualified(place).toString(), first, last, n, buckets)

    def _newest(self, runs: list[Run], keys: DataFrame | None) -> DataFrame:
        parts = []
        for order, run in enumerate(r for r in runs if r.rows or r == runs[0]):
            rows = self.spark.read.parquet(run.path)
            if keys is not None:
                rows = self._touched(rows, run, keys)
            parts.append(rows.drop("bucket").withColumn("_order", F.lit(order)))
        if not parts:
            raise ValueError(f"no table in {self.folder}")
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part, allowMissingColumns=True)
        if keys is not None:
            every = every.join(keys, self.key, "left_semi")
        if len(parts) == 1:
            return every.drop("_order")
        columns = [c for c in every.columns if c not in (self.key, "_order")]
        return every.groupBy(self.key).agg(F.max_by(F.struct(*columns), "_order").alias("_row")).select(self.key, "_row.*")

    def _touched(self, rows: DataFrame, run: Run, keys: DataFrame) -> DataFrame:
        """Without the buckets that no key falls into; their numbers are at most MAX_BUCKETS."""
        wanted = [r[0] for r in keys.select(self._bucket(run.buckets).alias("b")).distinct().collect()]
        return rows if len(wanted) * 2 > run.buckets else rows.where(F.col("bucket").isin(wanted))

    def _buckets(self, rows: int) -> int:
        buckets = 1
        while buckets * self.bucket_rows < rows and buckets < MAX_BUCKETS:
            buckets *= 2
        return buckets

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _place(self, path: str):
        place = self._path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())


def merge_into(store: Store, change: int, changed: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[Run]:
    """Apply a change: ``merge(rows, changed)`` gives the new rows of the keys of ``changed`` from their rows so far."""
    held = changed.persist()
    try:
        keys = held.select(store.key).distinct()
        n = keys.count()
        return store.write(change, merge(store.read(change - 1, keys), held), n) if n else []
    finally:
        held.unpersist()
