"""Data quality checks and schema changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlops.operators.skew import skew_join


def dq_domain_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows per broken rule, from one pass; a rule says what is allowed, and NULL is allowed."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def dq_duplicates(df: DataFrame, keys: dict[str, Column | str], where: Column | None = None) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    rows = df if where is None else df.where(where)
    cols = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in keys.items()]
    filled = rows.select(*cols).dropna(how="any")
    return filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def dq_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose filled foreign key has no parent."""
    ids = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return skew_join(child.where(F.col(child_key).isNotNull()), ids, [child_key], "left_anti")


def evolve(df: DataFrame, spec: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Add the missing columns of (name, type, default) with their defaults."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(default).cast(kind) for n, kind, default in spec if n.lower() not in have})
