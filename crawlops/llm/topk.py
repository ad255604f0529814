"""Exact top-k search by columnar branch and bound.

Vectors lie dimension by dimension.  For each query the scores grow by blocks of
dimensions; what the remaining dimensions can add is bounded by the product of the
remaining lengths, and candidates that can't reach the k-th best score any more leave the
columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlops.session import cut

SCALE = 1024
BLOCK = 8  # dimensions added at a time
QUERIES = 4096  # queries of one pass; their broadcast has this bound
ROWS = 8192  # candidates held in columns at a time
EXACT = 2.0**53


def quantized(df: DataFrame, vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows with ``vector``, the floors of the scaled components; rows with a null or non-finite component leave."""
    vec = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    usable = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(vec_col).isNotNull() & usable).withColumn("vector", vec)


def matrix(rows: list, size: int | None = None) -> np.ndarray:
    """Vectors as rows; the missing end of a shorter one counts as zeros."""
    size = max(map(len, rows), default=0) if size is None else size
    out = np.zeros((len(rows), size))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row[:size]
    return out


class Best:
    """The k best candidates of each query so far: higher score first, then smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k, self.ids = k, ids
        order = np.argsort(-(vectors**2).sum(axis=0), kind="stable")
        self.order, self.vectors = order, vectors[:, order]
        self.cuts = list(range(0, vectors.shape[1], BLOCK))
        self.rest = self.remaining(self.vectors.T)  # block x query
        self.found = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in ids]

    def remaining(self, columns: np.ndarray) -> np.ndarray:
        """Lengths of what is left of each vector after each block."""
        mass = [np.sqrt((columns[c + BLOCK :] ** 2).sum(axis=0)) for c in self.cuts]
        return np.array(mass).reshape(len(self.cuts), columns.shape[1])

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        columns = np.ascontiguousarray(vectors[:, self.order].T)
        if np.abs(self.vectors).sum(axis=1).max(initial=0) * np.abs(columns).max(initial=0) >= EXACT:
            return self.add_wide(ids, columns)
        rest, first = self.remaining(columns), None
        if self.cuts:
            first = self.vectors[:, :BLOCK] @ columns[:BLOCK]
        for q in range(len(self.ids)):
            scores, who = self.found[q]
            least = scores[-1] if len(scores) == self.k else -np.inf
            alive = np.flatnonzero(ids != self.ids[q])
            total = first[q][alive] if self.cuts else np.zeros(len(alive))
            for b, c in enumerate(self.cuts):
                if b:
                    total = total + self.vectors[q, c : c + BLOCK] @ columns[c : c + BLOCK, alive]
                keep = total + self.rest[b, q] * rest[b, alive] * (1 + 1e-9) + 0.5 >= least
                if keep.sum() * 2 < len(alive) or b == len(self.cuts) - 1:
                    alive, total = alive[keep], total[keep]  # compact the columns
                if not len(alive):
                    break
            self.merge(q, total, ids[alive])

    def add_wide(self, ids: np.ndarray, columns: np.ndarray) -> None:
        """Without bounds, in whole numbers of any size; scores beyond a long end at its limits."""
        whole = [[int(x) for x in column] for column in columns.T]
        for q, vector in enumerate(self.vectors):
            own, least, most = [int(x) for x in vector], -(2**63), 2**63 - 1
            pairs = [(i, min(most, max(least, sum(a * b for a, b in zip(own, c))))) for i, c in zip(ids, whole) if i != self.ids[q]]
            scores = np.array([s for _, s in pairs], dtype=object)
            self.merge(q, scores, np.array([i for i, _ in pairs], dtype=np.int64))

    def merge(self, q: int, scores: np.ndarray, who: np.ndarray) -> None:
        if not len(scores):
            return
        if len(scores) > 4 * self.k and scores.dtype != object:
            top = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, who = scores[top], who[top]
        scores = np.concatenate([self.found[q][0], scores])
        who = np.concatenate([self.found[q][1], who])
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], who[i]))[: self.k]
        self.found[q] = scores[order], who[order]


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates with the highest integer inner products.

    Queries go in blocks of bounded size against all candidates; every task keeps ``k`` rows
    a query, and the rows of all tasks are ranked at the end.  Components are floors of
    1024 * x.  Ties go to the smaller id; a query doesn't find rows with its own id.

    Vectors that are null or hold null or non-finite components take no part, nor do
    null ids; shorter vectors end in zeros; a repeated candidate counts each time, a
    repeated query id once, with its smallest vector; empty tables give no rows; other columns
    are not read.
    """
    spark = candidates.sparkSession
    rows = quantized(candidates.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")))
    rows = rows.where("vec_id IS NOT NULL").select("vec_id", "vector")
    asked = quantized(queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("embedding")))
    asked = asked.where("query_id IS NOT NULL").groupBy("query_id").agg(F.min("vector").alias("vector"))
    blocks = -(-asked.count() // QUERIES)
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1)))))
    found = None
    for block in range(max(blocks, 1)):
        own = asked.where(F.col("block") == block).orderBy("query_id").collect()
        size = max((len(r["vector"]) for r in own), default=0)
        held = spark.sparkContext.broadcast(
            (np.array([r["query_id"] for r in own], dtype=np.int64), matrix([r["vector"] for r in own], size))
        )
        part = rows.mapInArrow(search(held, size, k), "query_id long, vec_id long, score long")
        part = cut(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(held, size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = held.value
        best = Best(query_ids, vectors, k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                best.add(part.column(0).to_numpy(), matrix(part.column(1).to_pylist(), size))
        for query, (scores, who) in zip(query_ids, best.found):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(who), query), pa.int64()), pa.array(who, pa.int64()),
                    pa.array([int(s) for s in scores], pa.int64()),
                ],
                names=["query_id", "vec_id", "score"],
            )

    return run
