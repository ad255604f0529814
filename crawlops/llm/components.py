"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlops.session import cut

CROWDED = 1_000  # a key with more than this share of the rows is looked up in a broadcast; there are fewer such keys


def lookup(rows: DataFrame, table: DataFrame, key: str, sizes: DataFrame, total: int) -> DataFrame:
    """Join with a table of one row a key, where a few keys may hold most of the rows.

    ``sizes`` has the rows ``n`` of each key and ``total`` is their sum, so that less than
    CROWDED keys hold over ``total / CROWDED`` rows each: their part of the table is broadcast.
    """
    crowded = F.broadcast(cut(sizes.where(F.col("n") * CROWDED > total).select(key)))
    few = F.broadcast(table.join(crowded, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(crowded, key, "left_anti").join(table, key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: nodes of the same component have the same root.

    Each round joins every node with the one of lowest hash at most two steps away, so a star
    falls together at once.  The hashes change with the round, and the edges that are
    left shrink fast.  Nothing is collected but the number of edges left; a node with very
    many edges is combined before the shuffle or left to the adaptive skew join.
    """
    left = cut(both_ways(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))
    rounds: list[DataFrame] = []
    while left.count():
        turn = len(rounds)
        near = left.groupBy("a").agg(F.min(ranked(turn, "b")).alias("low"))
        near = near.select(F.col("a").alias("b"), F.least("low", ranked(turn, "a")).alias("low"))
        low = left.join(near, "b").groupBy("a").agg(F.min("low").alias("low"))
        steps = cut(low.select(F.col("a").alias("node"), F.col("low.v").alias("root")))
        rounds.append(steps)
        for name in ("a", "b"):
            to = steps.select(F.col("node").alias(name), "root")
            left = left.join(to, name).drop(name).withColumnRenamed("root", name)
        left = cut(left.where("a <> b").select("a", "b").distinct())
    if not rounds:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).limit(0)
    roots = rounds[0]
    for steps in rounds[1:]:
        later = steps.select(F.col("node").alias("root"), F.col("root").alias("later"))
        roots = roots.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return roots


def both_ways(edges: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.where("a <> b").distinct().select(F.explode(pairs).alias("p")).select("p.*")


def ranked(turn: int, name: str):
    return F.struct(F.xxhash64(F.col(name), F.lit(turn)).alias("h"), F.col(name).alias("v"))
