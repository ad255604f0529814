"""Groups that hold a large share of the rows.

A key counts as hot when its group is larger than ``hot_rows`` and larger than a millionth
of the table, so there are less than a million hot keys: what is kept per hot key, one
narrow row, can be broadcast.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlops.session import cut, micros

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 1_000_000  # a hot group holds more than this share of the rows
MAX_CELLS = 4_096  # a crowded key of a join holds more than this share of the joined rows
NO_TIME = -(1 << 62)  # before all times


@dataclass
class Hot:
    """Hot keys with their sizes (``_n``); a group has at most ``limit`` rows otherwise."""

    sizes: DataFrame
    limit: int
    keys: list[str]

    @property
    def names(self) -> DataFrame:
        return self.sizes.select(*self.keys)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = HOT_ROWS) -> Hot | None:
    """Keys whose group is hot, at most MAX_HOT_KEYS of them; None when there are none.

    Counting costs a pass over the key columns; ``hot_rows=None`` skips it where
    the caller knows the groups to be small.
    """
    if hot_rows is None:
        return None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, biggest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(hot_rows, (total or 0) // MAX_HOT_KEYS)
    if (biggest or 0) <= limit:
        return None
    return Hot(sizes.where(F.col("_n") > limit), limit, list(keys))


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal keys where NULL equals NULL; ``small`` broadcasts the right side."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(F.broadcast(other) if small else other, cond, how).drop(*[f"_r_{k}" for k in keys])


def skew_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int | None = HOT_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Equi join (inner, left, left_semi or left_anti) whose left side may be crowded on few keys.

    Left rows of a hot key are dealt out over as many salts as its group has limits, and the
    right rows of that key are repeated for each salt; all other keys have one salt.  Rows without a key meet nothing, but
    are dealt out alike.  The left side is made once, whatever it costs.  ``counted`` has the keys of at least the left
    rows, where those cost more to make.
    """
    on = list(on)
    hot = hot_keys(left if counted is None else counted, on, hot_rows)
    if hot is None:
        return left.join(right, on, how)
    salts = hot.sizes.select(*on, F.ceil(F.col("_n") / hot.limit).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    salted = match(left, salts, on, "left", small=True).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    repeated = right.join(F.broadcast(salts), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def pair_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ids: Sequence[str], right_ids: Sequence[str],
    hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None,
) -> DataFrame:
    """Inner equi join for many rows of a key on both sides, so that the joined rows outnumber those of both tables.

    A key with more than ``hot_rows`` joined rows, and a 4096th of all, is cut into cells: its left rows are dealt out over some
    parts by ``left_ids``, its right rows over others by ``right_ids``, and each part of one side meets each of the other.  The
    tasks follow the number of joined rows.  Each left row runs through the right rows of its cell, so the wider side should be left.
    ``sizes`` has the keys and about how many left rows each has (``_left``), where those cost more to make.
    """
    on = list(on)
    lefts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_left")) if sizes is None else sizes
    sizes = lefts.join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_right")), on)
    sizes = sizes.withColumn("_pairs", F.col("_left").cast("double") * F.col("_right"))
    total, biggest = sizes.agg(F.sum("_pairs"), F.max("_pairs")).first()
    limit = max(hot_rows, (total or 0) / MAX_CELLS)
    if (biggest or 0) <= limit:
        return left.join(right, on)
    cells = F.ceil(F.col("_pairs") / limit)
    across = F.greatest(F.lit(1), F.least(cells, F.round(F.sqrt(cells * F.col("_left") / F.col("_right")))))
    grid = sizes.where(F.col("_pairs") > limit).select(*on, across.cast("int").alias("_across"), F.ceil(cells / across).cast("int").alias("_down"))

    tasks = max(int(total / limit) + 1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, ids: Sequence[str], own: str, other: str) -> DataFrame:
        """Each row in its own part, once for every part of the other side; a key that is not crowded is one cell."""
        keyed = df.where(functools.reduce(operator.and_, [F.col(k).isNotNull() for k in on])).join(F.broadcast(grid), on, "left")
        placed = keyed.withColumn(f"{own}_at", F.pmod(F.xxhash64(*ids), F.coalesce(own, F.lit(1))).cast("int"))
        placed = placed.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        cell = F.to_json(F.struct(*on, "_across_at", "_down_at"))  # one text: whatever is known of a key, the join takes this shuffle
        return placed.withColumn("_cell", cell).drop("_across", "_down", "_across_at", "_down_at").repartition(tasks, "_cell")

    return dealt(left, left_ids, "_across", "_down").join(
        dealt(right, right_ids, "_down", "_across").drop(*on).hint("merge"), "_cell"
    ).drop("_cell")


def attach_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add group aggregates to every row of the group; NULL is a group of its own."""
    keys = list(keys)
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        group = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(group) for name, agg in stats.items()})
    table = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    crowded = match(df, match(table, hot.names, keys, "left_semi", small=True), keys, small=True)
    return crowded.unionByName(match(match(df, hot.names, keys, "left_anti", small=True), table, keys))


@dataclass
class Pieces:
    """Rows with the column ``_piece``; ``split`` says whether any key was cut."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool
    limit: int | None = None

    @property
    def window(self):
        return Window.partitionBy(*self.keys, "_piece").orderBy(*self.order)


def cut_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = HOT_ROWS) -> Pieces:
    """Cut hot groups into consecutive pieces smaller than the largest other group.

    Their rows are range-sorted by key and whole order, so rows of the same time part at their
    ids, and stored; the number of a row's part is its piece.  All other rows have piece 0.
    """
    keys, order = list(keys), list(order)
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return Pieces(df.withColumn("_piece", F.lit(0)), keys, order, False)
    rows, n = hot.sizes.agg(F.sum("_n"), F.count(F.lit(1))).first()
    names = hot.names
    crowded = match(df, names, keys, "left_semi", small=True).repartitionByRange(2 * -(-rows // hot.limit) + n, *keys, *order)
    stored = cut(crowded.withColumn("_piece", F.spark_partition_id() + 1))
    rest = match(df, names, keys, "left_anti", small=True).withColumn("_piece", F.lit(0))
    return Pieces(stored.unionByName(rest), keys, order, True, hot.limit)


def running(
    pieces: Pieces,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
) -> Pieces:
    """Running sums, running maxima (both with the current row) and previous values.

    Every piece is scanned on its own; what precedes a piece is folded from one
    row per piece and added afterwards.
    """
    sums, maxes, previous = sums or {}, maxes or {}, previous or {}
    w = pieces.window
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {name: F.sum(c).over(upto) for name, c in sums.items()}
    cols |= {name: F.max(c).over(upto) for name, c in maxes.items()}
    cols |= {name: F.lag(c).over(w) for name, c in previous.items()}
    if not pieces.split:
        return replace(pieces, df=pieces.df.withColumns(cols))

    totals = [F.sum(c).alias(f"_c_{name}") for name, c in sums.items()]
    totals += [F.max(c).alias(f"_c_{name}") for name, c in maxes.items()]
    totals += [F.max_by(c, F.struct(*pieces.order)).alias(f"_c_{name}") for name, c in previous.items()]
    by_piece = Window.partitionBy(*pieces.keys).orderBy("_piece")
    earlier = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.df.where("_piece > 0").groupBy(*pieces.keys, "_piece").agg(*totals)
    carry = {f"_c_{n}": F.sum(f"_c_{n}").over(earlier) for n in sums}
    carry |= {f"_c_{n}": F.max(f"_c_{n}").over(earlier) for n in maxes}
    carry |= {f"_c_{n}": F.lag(f"_c_{n}").over(by_piece) for n in previous}
    first = F.row_number().over(w)
    rows = pieces.df.withColumns(cols).withColumn("_first", first == 1)
    out = match(rows, ends.withColumns(carry), [*pieces.keys, "_piece"], "left", small=True)
    fixed = {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
    fixed |= {n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in maxes}
    fixed |= {n: F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(n)) for n in previous}
    out = out.withColumns(fixed).drop("_first", *carry)
    return replace(pieces, df=out)


def trailing(pieces: Pieces, seconds: int, values: dict[str, Column]) -> DataFrame:
    """Sums over the rows of the same key in the last ``seconds``, current row included, less the first row's value.

    Time is cut into cells as long as the window, so a window is the end of one cell and the begin of the next: both
    sums are running ones, and the cost does not follow the rows in a window.
    In hot groups that is the difference of two running sums: at the row itself and at the
    first row of its window.  Each row sends a probe to the begin of its window, and a
    running maximum from the end carries the next row's sum back to the probe, piece by
    piece, so no window is ever held as a whole.  ``order`` is a time and a number.
    """
    span = seconds * 1_000_000
    df = pieces.df.withColumn("_us", micros(pieces.order[0]))
    plain = _two_cells(df.where("_piece = 0"), pieces, span, values)
    if not pieces.split:
        return done(plain.drop("_us"))
    keys, (_, number) = pieces.keys, pieces.order
    exact = {f"_s_{n}": c.cast("decimal(38,9)") for n, c in values.items()}
    crowded = running(Pieces(df.where("_piece > 0"), keys, pieces.order, True), sums=exact).df.drop("_piece")
    begins = crowded.select(*keys, F.col("_us").alias("_at"), F.lit(0).alias("_probe"), F.col(number).alias("_id"), *exact)
    probes = crowded.withColumnsRenamed({s: f"{s}_own" for s in exact}).withColumns(
        {"_at": F.col("_us") - span, "_probe": F.lit(1), "_id": F.col(number)}
    )
    both = probes.unionByName(begins, allowMissingColumns=True)
    both = both.withColumns({c: -F.col(c) for c in ("_at", "_probe", "_id")})
    back = cut_hot(both, keys, ["_at", "_probe", "_id"], 2 * HOT_ROWS if pieces.limit is None else 2 * pieces.limit)
    nearest = F.when(F.col("_probe") == 0, F.struct("_at", "_id", *exact))
    found = running(back, maxes={"_next": nearest}).df.where("_probe = -1")
    grown = {n: (F.col(f"_s_{n}_own") - F.col(f"_next._s_{n}")).cast(df.select(c).schema[0].dataType) for n, c in values.items()}
    return done(found.withColumns(grown).drop("_next", "_at", "_probe", "_id", "_us", *exact, *[f"{s}_own" for s in exact])).unionByName(
        done(plain.drop("_us"))
    )


def _two_cells(df: DataFrame, pieces: Pieces, span: int, values: dict[str, Column]) -> DataFrame:
    """What ``trailing`` gives for groups that are not hot.  Rows without a time are a window of their own.

    The first row of a window follows the last row that is too old for it.
    """
    head, tail, own = ([f"_{part}_{n}" for n in values] for part in ("head", "tail", "own"))
    us = F.coalesce("_us", F.lit(NO_TIME))
    df = df.withColumn("_seq", F.row_number().over(pieces.window))
    df = df.withColumns({"_at": us, "_cell": us - F.pmod(us, F.lit(span))} | dict(zip(own, values.values())))
    cells, series = Window.partitionBy(*pieces.keys, "_cell"), Window.partitionBy(*pieces.keys)
    upto, start = (Window.unboundedPreceding, Window.currentRow), F.col("_start")
    for names, order in ((tail, F.desc("_at")), (head, F.asc("_at"))):
        df = df.withColumns({n: F.sum(c).over(cells.orderBy(order).rangeBetween(*upto)) for n, c in zip(names, own)})
    df = df.withColumn("_begin", F.struct("_cell", *tail, *own))
    df = df.withColumn("_follows", F.lead("_begin").over(series.orderBy("_at", "_seq")))
    old = F.last("_follows").over(series.orderBy("_at").rangeBetween(Window.unboundedPreceding, -span))
    df = df.withColumn("_start", F.coalesce(old, F.first("_begin").over(series.orderBy("_at").rangeBetween(*upto))))
    for n, h, t, c in zip(values, head, tail, own):
        earlier = F.when(start["_cell"] < F.col("_cell"), start[t])
        df = df.withColumn(n, F.coalesce(earlier + F.col(h), earlier, F.col(h)) - start[c])
    return df.drop("_seq", "_at", "_cell", "_begin", "_follows", "_start", *head, *tail, *own)


def done(df: DataFrame) -> DataFrame:
    """Drop the helper column of a cut table."""
    return df.drop("_piece")
