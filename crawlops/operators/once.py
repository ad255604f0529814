"""Columns that are computed a single time, however often later steps use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed a single time, however often later steps use them.

    The optimizer would otherwise copy a long expression into every filter and
    projection above it; it does not move expressions through a generator.
    """
    return spread(df, F.struct(*[c.alias(n) for n, c in cols.items()]))


def spread(df: DataFrame, fields: Column) -> DataFrame:
    """Add the fields of a struct as columns, computed a single time.

    The struct is built in a projection of its own, where common parts are shared.
    """
    return df.withColumn("_once", fields).select(*df.columns, F.inline(F.array("_once")))
