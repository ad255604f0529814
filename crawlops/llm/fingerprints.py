"""SimHash fingerprints in built-in functions, and their neighbours by permuted block tables.

Every term of a text votes with its weight for or against each bit of the fingerprint.  The
votes of two bits share a long, so 32 sums count 64 bits.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
HALF = 32
LANES = (1 << 32) | 1  # lowest bit of either half
RANGES = 256  # of the id order, cut at quantiles
CELLS = 256  # of each range, of equal width, at most
ROWS = 2_000  # wanted in a cell
BLOCKS = 6
EVERY_WEIGHT = 8  # characters of a term for one more vote


def terms(text: Column) -> Column:
    """Array of the words of a text: what stands between white space, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def votes(df: DataFrame, keys: list[str], words: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """``keys, total, lane_0 .. lane_31``: weights of all terms and of those that have a bit set.

    A term is three words in a row; the last two of a text are shorter.  Words of a text become rows in the task that holds it and are summed there.  A weight is one
    and one more for every eight characters; all weights of a text together are less than its
    bytes, so no half of a lane overflows.
    """
    shifted = [F.expr(f"slice({words}, {i}, size({words}))") for i in (2, 3)]
    zipped = F.arrays_zip(F.col(words).alias("a"), shifted[0].alias("b"), shifted[1].alias("c"))
    rows = df.select(*keys, *carried, F.explode_outer(zipped).alias("t")).select(
        *keys,
        *carried,
        F.when(F.col("t.a").isNotNull(), F.xxhash64("t.a", "t.b", "t.c")).alias("h"),
        F.floor(1 + (F.length("t.a") + F.coalesce(F.length("t.b"), F.lit(0)) + F.coalesce(F.length("t.c"), F.lit(0))) / EVERY_WEIGHT).alias("w"),
    )
    lanes = [
        F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"lane_{i}") for i in range(HALF)
    ]
    return rows.groupBy(*keys).agg(F.sum("w").alias("total"), *lanes, *[F.max(c).alias(c) for c in carried])


def fingerprint(total: Column) -> Column:
    """The bits that got more than half of the votes, from lanes; zero for a text without terms."""
    bits = F.lit(0).cast("long")
    for i in range(HALF):
        lane = F.col(f"lane_{i}")
        low, high = lane.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(lane, 32)
        bits = bits.bitwiseOR(F.when(2 * low > total, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        upper = 1 << (i + HALF)
        bits = bits.bitwiseOR(F.when(2 * high > total, F.lit(upper - (1 << 64) if i == HALF - 1 else upper)).otherwise(F.lit(0)).cast("long"))
    return F.when(total.isNull(), F.lit(0).cast("long")).otherwise(bits)


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every distinct pair of id and text; a null or empty text has fingerprint zero."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = plain.select("doc_id", F.xxhash64("text").alias("_text"), terms(F.col("text")).alias("words"))
    return votes(keyed, ["doc_id", "_text"], "words").select("doc_id", fingerprint(F.col("total")).alias("fp"))


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """``query, fp, distance``: all distinct ``fp`` of the first table within ``radius`` bits of the queries.

    The bits are cut into blocks; at most ``radius`` of them differ, so each choice of the
    others is the leading part of one permuted table, and a neighbour is found in the table
    whose leading blocks are all equal.  Only the table of the first such choice keeps it.
    Null fingerprints take no part.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    leading = [sum(masks[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in leading]

    def table(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
        return df.where(F.col(name).isNotNull()).select(name).distinct().select(name, F.explode(keys).alias("k")).select(name, "k.table", "k.key")

    apart = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.lit(len(signed))
    for i, m in reversed(list(enumerate(signed))):
        first = F.when(apart.bitwiseAND(F.lit(m)) == 0, i).otherwise(first)
    a, b = table(queries.select(F.col("fp").alias("query")), "query"), table(fps.select("fp"), "fp")
    found = a.join(b.withColumnsRenamed({"table": "_table", "key": "_key"}), [F.col("table") == F.col("_table"), F.col("key") == F.col("_key")])
    near = found.where((F.bit_count(apart) <= radius) & (first == F.col("table")))
    return near.select("query", "fp", F.bit_count(apart).alias("distance"))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, next, bucket, place, copy``: texts with the next one by ascending id.

    Ids are cut into ranges at quantiles and these into cells.  The rows of the first id of a cell are
    repeated (``copy``) behind the cell before it, those of the first of all behind the last, so
    every cell is complete in itself and only one shuffle moves the texts.  The table of first ids
    has one row a cell, at most RANGES * CELLS.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = [i / RANGES for i in range(1, RANGES)]
    n, low, high, inner = plain.agg(
        F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", share, 20 * RANGES)
    ).first()
    cells = max(1, min(CELLS, -(-n // (RANGES * ROWS))))
    begins = sorted({low, *(inner or [])} - {None})
    if not begins:
        begins, high = [0], 0
    edges = F.array(*[F.lit(b) for b in (*begins, high + 1)])
    at = F.size(F.filter(F.array(*[F.lit(b) for b in begins]), lambda b: b <= F.col("doc_id")))
    start, end = F.element_at(edges, F.col("range")), F.element_at(edges, F.col("range") + 1)
    cell = F.floor((F.col("doc_id").cast("double") - start) / (end.cast("double") - start) * cells)
    cell = F.least(cell, F.lit(cells - 1))
    ranged = plain.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(at))
    bucketed = ranged.withColumn("bucket", F.when(F.col("range") == 0, F.lit(0)).otherwise(F.col("range") * cells + cell).cast("long"))
    firsts = bucketed.groupBy("bucket").agg(F.min("doc_id").alias("least"))
    every = Window.orderBy("bucket")
    last = F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = firsts.select("bucket", "least", F.coalesce(F.lag("bucket").over(every), last).alias("before"))
    same = (F.col("doc_id").eqNullSafe(F.col("least"))) & (F.col("bucket") == F.col("_bucket"))
    marked = bucketed.join(F.broadcast(before.withColumnRenamed("bucket", "_bucket")), same, "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy"))
    other = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy"))
    to = F.when(F.col("before").isNotNull(), F.array(own, other)).otherwise(F.array(own))
    rows = marked.select("doc_id", "text", F.explode(to).alias("to")).select("doc_id", "text", "to.bucket", "to.copy")
    w = Window.partitionBy("bucket").orderBy("copy", F.asc_nulls_first("doc_id"), "text")
    return rows.withColumns({"place": F.row_number().over(w), "next": F.lead("text").over(w)})


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and of the next documents.

    The last quarter of the characters of a text (rounded down) is replaced by as many
    from the start of the next text by ascending id, or by all it has; the last
    document is followed by the first.  ``near_edited`` and ``near_next`` are shares of equal
    bits.  All of it is one shuffle of the texts and built-in functions.

    A null text counts as empty and has fingerprint zero; null ids come first in order; rows with
    the same id are ordered by their texts and stay; a single document follows itself; an empty
    table gives no rows; other columns are not read.
    """
    rows = in_order(docs, id_col, text_col)
    size = F.length("text")
    tail = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - tail), F.substring("next", F.lit(1), tail))
    sha = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha_{i}") for i in range(4)]
    both = rows.select("bucket", "place", "copy", "doc_id", "text", size.cast("long").alias("n_chars"), edited.alias("edited"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    kinds = F.slice(kinds, 1, F.when(F.col("copy") == 1, 1).otherwise(2))
    carried = ("copy", "doc_id", "n_chars", *(f"sha_{i}" for i in range(4)))  # numbers, so that sums are hashed
    spread = both.select("bucket", "place", "copy", "doc_id", "n_chars", *quarters, F.explode(kinds).alias("k"))
    worded = spread.select("bucket", "place", F.col("k.kind").alias("kind"), *carried, terms(F.col("k.t")).alias("words"))
    found = votes(worded, ["bucket", "place", "kind"], "words", carried)
    found = found.select("bucket", "place", "kind", *carried, fingerprint(F.col("total")).alias("fp"))
    by_kind = [F.max(F.when(F.col("kind") == k, F.col("fp"))).alias(name) for k, name in enumerate(("fp", "edited_fp"))]
    own = found.groupBy("bucket", "place").agg(*by_kind, *[F.max(c).alias(c) for c in carried])
    after = F.lead("fp").over(Window.partitionBy("bucket").orderBy("place"))
    done = own.withColumn("next_fp", after).where("copy = 0")
    return done.select(
        "doc_id", "n_chars", F.concat(*[hex_digits(F.col(f"sha_{i}")) for i in range(4)]).alias("edited_sha256"),
        hex_digits(F.col("fp")).alias("fingerprint"), hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
