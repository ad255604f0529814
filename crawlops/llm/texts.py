"""Running a text function over whole tables in Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CACHED_KEYS = 400_000  # entries of a per-worker cache, unless another limit is given
CACHED_LENGTH = 64  # longer keys are not kept
TEXTS_AT_ONCE = 500  # of an Arrow batch; ten thousand long texts would lie in memory twice, in Spark and in Python
BATCH, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few texts, unless the session has a size of its own."""
    if spark.conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH, str(TEXTS_AT_ONCE))


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[str], tuple | list]], schema: str, *, many: bool = False, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows ``(doc_id, *values)`` with the values that a function finds for each whole text.

    ``make`` builds the function once per task.  It returns the values of one row,
    or with ``many`` a list of such rows.  A null text counts as empty, a null id stays;
    other columns are not read.
    """
    small_batches(df.sparkSession)
    out = StructType.fromDDL(schema)
    kind = df.schema[id_col].dataType
    full = StructType().add("doc_id", kind)
    for field in out.fields:
        full.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(full)
        find = make()
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1).to_pylist()):
                values = find(text)
                if many:
                    found.extend((doc, *v) for v in values)
                else:
                    found.append((doc, *values))
            columns = list(zip(*found)) if found else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    plain = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(run, full)


_HELD: dict = {}


def held(key: tuple, build: Callable):
    """What a worker keeps from task to task: the tables and caches of the operator that it ran last.

    Those of another operator are let go first, as a worker serves one after the other.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = build()
    return _HELD[key]


class Cache(dict):
    """What ``find`` gives for a key; the first keys seen are kept, up to a limit."""

    def __init__(self, find: Callable, limit: int = CACHED_KEYS):
        super().__init__()
        self.find, self.limit = find, limit

    def __missing__(self, key: str):
        value = self.find(key)
        if len(self) < self.limit and len(key) <= CACHED_LENGTH:
            self[key] = value
        return value
