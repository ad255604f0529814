"""Near-duplicate classes by SimHash fingerprints and fuzzy hashing with the Golay code.

A fingerprint is cut into segments of 22, 21 and 21 bits.  If two fingerprints differ in at
most four bits, two of their segments differ in at most two bits together: either one is
equal and the other differs in up to two bits, or both differ in exactly one.  Codeword
indices of the segments, several for each, give keys that such fingerprints share; those that
share a key are verified by their bit distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlops.llm.components import components, lookup
from crawlops.llm.golay import BITS, DATA, near_codewords
from crawlops.llm.texts import map_texts, small_batches
from crawlops.session import cut

SHINGLE = 4
MAX_BITS = 4
SEED = 42
CHUNK = 65_536  # shingles hashed at a time
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
CELLS = 1 << 20  # counters that find crowded keys
SAMPLED = 16  # one fingerprint in so many is counted
CROWD = 1 << 16  # keys with more fingerprints than that are dealt out over several tasks
ROUND_ROBIN = 64  # keys of at most so many fingerprints are compared at once


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half the hashes of all word shingles; fewer words make one shingle, none gives zero."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = (ends - np.fromiter(map(len, words), np.int64, len(words)))[: len(words) - size + 1].tolist()
    ends, digest = ends[size - 1 :].tolist(), xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(begins), CHUNK):
        part = [digest(joined[b:e], SEED) for b, e in zip(begins[at : at + CHUNK], ends[at : at + CHUNK])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * votes > len(begins)))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every whole text, ``fp`` as a signed long."""
    return map_texts(docs, lambda: lambda text: (signed(fingerprint(text, shingle)),), "fp long", id_col=id_col, text_col=text_col)


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    small_batches(SparkSession.active())

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([signed(fingerprint(t or "", shingle)) for t in texts.to_pylist()], pa.int64())

    return run(text)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and the place of the fingerprint that each one belongs to."""
    words = fps.view(np.uint64)
    parts = [(words >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    near = [near_codewords(p) for p in parts]
    odd = [np.bitwise_count(p.view(np.uint64)).astype(np.int64) & 1 for p in parts]
    rows, keys, who = np.arange(len(fps)), [], []

    def add(kind: int, key: np.ndarray, fits: np.ndarray) -> None:
        keys.append((kind << 56 | key)[fits])
        who.append(rows[fits])

    for kind, (i, j) in enumerate(itertools.permutations(range(3), 2)):  # equal here, up to two bits there
        for c in range(near[j].shape[1]):
            add(kind, parts[i] << DATA | near[j][:, c], near[j][:, c] >= 0)
    for kind, (i, j) in enumerate(itertools.combinations(range(3), 2), 6):
        # One bit each: of two such segments one has even parity and gives its nearest codeword,
        # the other one is odd and gives all that are near.  Which of both holds is the same on both sides.
        same = (odd[i] ^ odd[j]) << (2 * DATA)
        for c, d in itertools.product(range(near[i].shape[1]), range(near[j].shape[1])):
            fits = (near[i][:, c] >= 0) & (near[j][:, d] >= 0) & ((odd[i] == 1) | (c == 0)) & ((odd[j] == 1) | (d == 0))
            add(kind, same | near[i][:, c] << DATA | near[j][:, d], fits)
    return np.concatenate(keys), np.concatenate(who)


def crowded_cells(fps: DataFrame) -> np.ndarray:
    """Into how many parts the fingerprints of each cell of keys are cut, from a sample; one for most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = keys_of(batch.column(0).to_numpy())
            cells, n = np.unique(cell(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], names=["cell", "n"])

    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).select("fp").mapInArrow(count, "cell long, n long")
    most = sample.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") * SAMPLED > CROWD).toArrow()
    parts = np.ones(CELLS, dtype=np.int64)
    parts[most.column("cell").to_numpy()] = -(-most.column("n").to_numpy() * SAMPLED // CROWD)
    return parts


def cell(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def key_rows(fps: DataFrame, parts: np.ndarray) -> DataFrame:
    """``key, grid, fp``; the fingerprints of a crowded key meet in pairs of parts, one grid place for each pair."""
    held = fps.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            keys, who = keys_of(own)
            found = own[who]
            cuts = held.value[cell(keys)]
            part = (found.view(np.uint64) % cuts.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(keys)), cuts)
            other = np.arange(len(again)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            low, high = np.minimum(part[again], other), np.maximum(part[again], other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[again]), pa.array(low << 24 | high), pa.array(found[again])], names=["key", "grid", "fp"]
            )

    return fps.select("fp").mapInArrow(run, "key long, grid long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that hold each component of a crowded key together, found breadth first."""
    open_ = np.unique(fps)
    while len(open_):
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            here = np.array([front.pop()])
            near = distance(open_, here) <= max_bits
            found, open_ = open_[near], open_[~near]
            if len(found):
                yield np.repeat(here, len(found)), found
                front.extend(found)


def linked(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Verified links of rows that come ordered by key and grid place."""

    def groups(rows: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, grid, fp = rows
        change = np.flatnonzero((key[1:] != key[:-1]) | (grid[1:] != grid[:-1])) + 1
        begins = np.concatenate([[0], change])
        sizes = np.diff(np.append(begins, len(key)))
        group, size_of = np.repeat(np.arange(len(begins)), sizes), np.repeat(sizes, sizes)
        few = size_of <= ROUND_ROBIN
        for apart in range(1, int(sizes[sizes <= ROUND_ROBIN].max(initial=1))):
            a = np.flatnonzero(few[:-apart] & (group[apart:] == group[:-apart]))
            close = a[distance(fp[a], fp[a + apart]) <= max_bits]
            if len(close):
                yield fp[close], fp[close + apart]
        for g in np.flatnonzero(sizes > ROUND_ROBIN):
            yield from forest(fp[begins[g] : begins[g] + sizes[g]], max_bits)

    def edges(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        found = list(groups(rows)) if len(rows[0]) > 1 else []
        if found:
            a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = tuple(c.to_numpy() for c in batch.columns)
        change = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
        last = int(change[-1]) if len(change) else 0
        if last or held and (held[-1][0][-1], held[-1][1][-1]) != (rows[0][0], rows[1][0]):
            yield from edges(tuple(np.concatenate(c) for c in zip(*held, tuple(r[:last] for r in rows))))
            held = []
        held.append(tuple(r[last:] for r in rows))
    if held:
        yield from edges(tuple(np.concatenate(c) for c in zip(*held)))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints within ``max_bits`` that connect what is connected.

    ``fps`` holds distinct ``fp``; ``max_bits`` is at most four, as the keys allow.
    """
    if max_bits > 4:
        raise ValueError("the keys of these segments find at most four differing bits")
    rows = key_rows(fps, crowded_cells(fps))
    spread = rows.repartition(F.col("key"), F.col("grid")).sortWithinPartitions("key", "grid")
    return spread.mapInArrow(lambda batches: linked(batches, max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", fp_col: str | None = None
) -> DataFrame:
    """``doc_id, fp, component_id, root``: class of each document under chains of near fingerprints.

    Stored documents that have their fingerprints (of ``fingerprint_of``) in ``fp_col`` are not hashed again.

    ``component_id`` is the smallest id of the class (null ids don't count; null if there is no
    other), ``root`` a fingerprint that names the class.  Equal fingerprints fall together before
    anything is compared, so copies cost nothing.  A null or empty text has the fingerprint zero
    and is linked like any other; repeated rows stay; an empty table gives no rows; other columns
    are not read.
    """
    known = fp_col is not None
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(fp_col).alias("fp")) if known else cut(fingerprints(docs, shingle, id_col, text_col))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(fps, max_bits))
    joined = cut(roots.join(fps, roots["node"] == fps["fp"]).select("fp", "least", "root"))
    classes = joined.groupBy("root").agg(F.min("least").alias("lowest"))
    named = fps.join(joined.join(classes, "root").select("fp", "root", "lowest"), "fp", "left")
    alone = F.col("root").isNull()
    low = F.when(alone, F.col("least")).otherwise(F.col("lowest")).alias("component_id")
    named = cut(named.select("fp", "n", F.coalesce("root", "fp").alias("root"), low))
    total = named.agg(F.sum("n")).first()[0] or 0
    found = lookup(rows, named.drop("n"), "fp", named.select("fp", "n"), total)
    return found.select("doc_id", "fp", "component_id", "root")
