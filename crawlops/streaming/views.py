"""Summaries that are kept up to date by what changed.

A change is a table of signed rows: 1 for a row that came, -1 for one that went, both for one that
was updated.  Sums and counts of each touched group grow by the signed values; a maximum is taken anew from the
rows of its group only where the change withdrew it.  Groups that no row touches are not written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlops.streaming.store import Run, Store

ROWS = "_rows"  # of the group, so that an empty one is known


@dataclass(frozen=True)
class View:
    """Columns of a summary: its ``keys``, and expressions over a row that are summed or whose maximum is kept."""

    keys: list[str]
    sums: dict[str, Column]
    maxes: dict[str, Column]

    def key(self) -> Column:
        return F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})

    def deltas(self, changes: DataFrame) -> DataFrame:
        """One row for each touched group: what its sums grow by, the largest value that came and that went."""
        sign = F.col("sign")
        totals = [F.sum(sign * F.coalesce(c.cast("bigint"), F.lit(0))).alias(n) for n, c in self.sums.items()]
        tops = [F.max(F.when(sign > 0, c)).alias(n) for n, c in self.maxes.items()]
        gone = [F.max(F.when(sign < 0, c)).alias(f"_gone_{n}") for n, c in self.maxes.items()]
        return changes.groupBy(*self.keys).agg(F.sum(sign).cast("bigint").alias(ROWS), *totals, *tops, *gone).withColumn("_key", self.key())


def apply_changes(store: Store, change: int, view: View, changes: DataFrame, rows_of: Callable[[DataFrame], DataFrame]) -> list[Run]:
    """Bring a stored summary up to date with a change; ``store`` has the key ``_key``.

    ``rows_of`` gives the rows after the change of the groups it gets (the view's keys, one row each);
    it is asked for groups that lost their maximum.
    """
    new = view.deltas(changes).persist()
    try:
        touched = new.count()
        if not touched:
            return []
        if change < 0:
            return store.write(change, new.drop(*[f"_gone_{n}" for n in view.maxes]), touched)
        old = store.read(change - 1, new.select("_key")).alias("o")
        both = new.alias("n").join(old, "_key", "left")
        lost = F.lit(False)
        for n in view.maxes:
            # what came in the same change may be larger than what went, else the stored maximum is withdrawn
            stays = F.coalesce(F.col(f"n.{n}") >= F.col(f"o.{n}"), F.lit(False))
            lost = lost | (F.coalesce(F.col(f"n._gone_{n}") >= F.col(f"o.{n}"), F.lit(False)) & ~stays)
        merged = both.select(
            "_key", *[F.col(f"n.{k}").alias(k) for k in view.keys], lost.alias("_lost"),
            *[(F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.col(f"n.{c}")).alias(c) for c in (ROWS, *view.sums)],
            *[F.greatest(f"o.{n}", f"n.{n}").alias(n) for n in view.maxes],
        ).persist()
        try:
            out = merged.where(~F.col("_lost")).drop("_lost")
            again = merged.where("_lost")
            if not again.isEmpty():
                tops = rows_of(again.select(*view.keys)).groupBy(view.key().alias("_key")).agg(*[F.max(c).alias(n) for n, c in view.maxes.items()])
                out = out.unionByName(again.drop("_lost", *view.maxes).join(tops, "_key", "left"))
            return store.write(change, out, touched)
        finally:
            merged.unpersist()
    finally:
        new.unpersist()


def read_view(store: Store, view: View) -> DataFrame:
    """The groups that have rows."""
    return store.read().where(F.col(ROWS) > 0).select(*view.keys, *view.sums, *view.maxes)


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """A change from the rows that it replaces and the rows that it leaves."""
    return old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)), allowMissingColumns=True)
