"""Near-duplicate classes by an inverted join over the coordinates of MinHash signatures.

Two sets of Jaccard similarity s agree in each coordinate of their signatures with probability s.
The first POSTED coordinates are posted: a pair that is similar enough shares at least
``least_matches(POSTED)`` of them but once in a few hundred thousand pairs at the threshold.  As
they are ordered from rare to common coordinate values, pairs with so many matches share one within the
first places of both (the prefix), so only these are posted.  In a list, sets of too different
size are skipped, matches are counted over all coordinates, and what reaches the match threshold is
confirmed on the full sets.

A list of many sets is not paired out.  Its sets are compared with the one that is most like the others
first, which joins most of what belongs together.  What is not joined yet and still has a match in
another class meets again with its whole sets: a spanning forest of the links is found where they lie,
so no task returns more rows than it reads.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlops.llm.components import components, lookup
from crawlops.llm.texts import Cache, held, map_texts
from crawlops.session import cut

SHINGLE = 2
SIMILARITY = 80  # percent
POSTED = 16  # coordinates that are posted
COORDINATES = 64  # coordinates whose matches are counted
MISSED = 5e-6  # share of pairs at the threshold that either count may lose
CHUNK = 512  # shingles hashed at a time
CELLS = 1 << 20  # counters of coordinate values
FEW = 4  # lists of at most so many sets are paired out at once
CROWD = 1_024  # sets of a longer list are dealt out over pairs of parts
AT_PIVOT = 256  # members that are confirmed with one pivot in a task, about
GOLDEN = 0x9E3779B97F4A7C15


@functools.cache
def least_matches(coordinates: int, similarity: int = SIMILARITY) -> int:
    """Most matches that all but MISSED of the pairs at the threshold reach."""
    s, below = similarity / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * s**k * (1 - s) ** (coordinates - k)
        if below > MISSED:
            return k
    return coordinates


@functools.cache
def family() -> tuple[np.ndarray, np.ndarray]:
    """Two fixed numbers for each coordinate: one turns bits over, the odd one multiplies."""
    digest = [xxhash.xxh3_64_intdigest(f"{kind}{i}") for kind in "xm" for i in range(COORDINATES)]
    both = np.array(digest, dtype=np.uint64).reshape(2, COORDINATES, 1)
    return both[0], both[1] | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str, size: int, hashed: Cache) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; all words are one shingle if there are fewer than ``size``."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.empty(0, dtype=np.uint64)
    size = min(size, len(words))
    each = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):  # shingles of other lengths begin with another number
        out = mixed(out * np.uint64(GOLDEN) + each[k : len(words) - size + 1 + k])
    return np.unique(out)


def word_hashes() -> Cache:
    return held(("shingles",), lambda: Cache(xxhash.xxh3_64_intdigest))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash of the set under each member of the family."""
    turned, odd = family()
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[None, at : at + CHUNK]
        low = np.minimum(low, ((part ^ turned) * odd).min(axis=1))
    return low


def posted(low: np.ndarray) -> np.ndarray:
    """Keys of the posted coordinates of many signatures: coordinate and value together."""
    return mixed(low ^ np.arange(1, POSTED + 1, dtype=np.uint64) * np.uint64(GOLDEN))


def prefix_of(keys: np.ndarray, counts: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of keys the rarest ones and their counts, in one order of values for all sets."""
    n = counts[cell(keys)]
    first = np.lexsort((keys, n), axis=1)[:, : POSTED - least_matches(POSTED, similarity) + 1]
    return np.take_along_axis(keys, first, axis=1), np.take_along_axis(n, first, axis=1)


def cell(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(44)).astype(np.int64)


def matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of a column of equally long binary values."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def described(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, set_id, n, source, keys, sig``: the set of each whole text, its size and its signature.

    ``keys`` are those of the posted coordinates, ``sig`` a byte of each coordinate; equal sets
    have the same ``set_id``, a digest of all shingles, and the empty set has none.  ``source`` tells
    texts apart.
    """

    def make():
        hashed = word_hashes()

        def find(text: str) -> tuple:
            own = shingle_set(text, shingle, hashed)
            if not len(own):
                return None, 0, 0, None, None
            low = signature(own)
            digest = xxhash.xxh3_64_intdigest(own.tobytes())
            sig = mixed(low).astype(np.uint8)
            return signed(digest), len(own), signed(xxhash.xxh64_intdigest(text, 42)), posted(low[:POSTED]).tobytes(), sig.tobytes()

        return find

    return map_texts(docs, make, "set_id long, n long, source long, keys binary, sig binary", id_col=id_col, text_col=text_col)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def common_cells(sets: DataFrame) -> np.ndarray:
    """How many coordinate values fall into each cell; a table of fixed size orders values from rare to common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, n = np.unique(cell(matrix(batch.column(0), np.uint64, POSTED).ravel()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], names=["cell", "n"])

    found = sets.select("keys").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CELLS, dtype=np.int64)
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return table


def postings(sets: DataFrame, counts, similarity: int) -> DataFrame:
    """``key, grid, set_id, n, sig``: each set under the values of its prefix.

    The sets of a crowded value meet in pairs of parts, one grid place for each pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = prefix_of(matrix(batch.column(2), np.uint64, POSTED), counts.value, similarity)
            who = np.repeat(np.arange(len(keys)), keys.shape[1])
            shared = n.ravel() > 1  # a value that no other set has joins nothing
            keys, n, who = keys.ravel()[shared], n.ravel()[shared], who[shared]
            cuts = -(-n // CROWD)
            ids = batch.column(0).to_numpy().view(np.uint64)[who]
            part = (mixed(ids) % cuts.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(keys)), cuts)
            other = np.arange(len(again)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            low, high = np.minimum(part[again], other), np.maximum(part[again], other)
            rows = pa.array(who[again])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[again].view(np.int64)), pa.array(low << 24 | high), *[batch.column(c).take(rows) for c in (0, 1, 3)]],
                names=["key", "grid", "set_id", "n", "sig"],
            )

    return sets.select("set_id", "n", "keys", "sig").mapInArrow(run, "key long, grid long, set_id long, n long, sig binary")


def by_list(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("key"), F.col("grid")).sortWithinPartitions("key", "grid")


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come ordered by key and grid place, cut between lists, and where each list begins and ends."""

    def changes(batch) -> np.ndarray:
        key, grid = (batch.column(c).to_numpy() for c in (0, 1))
        return np.flatnonzero((key[1:] != key[:-1]) | (grid[1:] != grid[:-1])) + 1

    def closed(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, np.concatenate([[0], changes(table), [len(table)]])

    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = changes(batch)
        last = int(cuts[-1]) if len(cuts) else 0
        end = [open_[-1].column(c)[-1].as_py() for c in (0, 1)] if open_ else None
        if last or end and end != [batch.column(c)[0].as_py() for c in (0, 1)]:
            parts = [*open_, batch.slice(0, last)] if last else open_
            yield closed(parts)
            open_ = []
        open_.append(batch.slice(last))
    if open_:
        yield closed(open_)


def alike(sig: np.ndarray, one: np.ndarray, similarity: int) -> np.ndarray:
    """Which signatures match another one often enough."""
    return (sig == one).sum(axis=-1) >= least_matches(COORDINATES, similarity)


def near_size(n: np.ndarray, one: np.ndarray, similarity: int) -> np.ndarray:
    return np.minimum(n, one) * 100 >= np.maximum(n, one) * similarity


def first_pairs(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """``key, grid, pivot, member``: all pairs of short lists that may be links; of a longer one those with one pivot.

    The pivot is the set most like the list as a whole, so the text that the others were made from comes
    first.  Sets of longer lists are returned as well, with ``pivot`` null.
    """

    def rows(key: int, grid: int, pivot, member: np.ndarray) -> pa.RecordBatch:
        size = len(member)
        pivots = pa.nulls(size, pa.int64()) if pivot is None else pa.array(np.broadcast_to(pivot, size))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, key)), pa.array(np.full(size, grid)), pivots, pa.array(member)], names=["key", "grid", "pivot", "member"]
        )

    for table, begins in whole_lists(batches):
        ids, n = table.column("set_id").to_numpy(), table.column("n").to_numpy()
        sig, sizes = matrix(table.column("sig"), np.uint8, COORDINATES), np.diff(begins)
        group, size_of = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes)
        for apart in range(1, int(sizes[sizes <= FEW].max(initial=1))):
            a = np.flatnonzero((size_of[:-apart] <= FEW) & (group[apart:] == group[:-apart]))
            a = a[near_size(n[a], n[a + apart], similarity)]
            a = a[alike(sig[a], sig[a + apart], similarity)]
            yield rows(0, 0, np.minimum(ids[a], ids[a + apart]), np.maximum(ids[a], ids[a + apart]))
        for g in np.flatnonzero(sizes > FEW):
            own = slice(begins[g], begins[g + 1])
            yield rows(table.column("key")[begins[g]].as_py(), table.column("grid")[begins[g]].as_py(), None, ids[own])
            usual = np.array([np.bincount(c, minlength=256).argmax() for c in sig[own].T]).astype(np.uint8)
            p = begins[g] + np.lexsort((ids[own], -(sig[own] == usual).sum(axis=1)))[0]
            fits = near_size(n[own], n[p], similarity) & alike(sig[own], sig[p], similarity) & (ids[own] != ids[p])
            yield rows(0, 0, ids[p], ids[own][fits])


def unsettled(batches: Iterator[pa.RecordBatch], counts, similarity: int) -> Iterator[pa.RecordBatch]:
    """``key, grid, set_id`` of the sets of longer lists that match one of another class.

    Sets of too different sizes are skipped, and a pair counts in one list only: that of the smallest
    value that both have in their prefixes.
    """
    for table, begins in whole_lists(batches):
        key, ids, size, root = (table.column(c).to_numpy() for c in ("key", "set_id", "n", "root"))
        sigs = matrix(table.column("sig"), np.uint8, COORDINATES)
        keys = matrix(table.column("keys"), np.uint64, POSTED)
        chosen = np.sort(prefix_of(keys, counts.value, similarity)[0], axis=1)
        found = np.zeros(len(ids), dtype=bool)
        for begin, end in zip(begins, begins[1:]):
            order = begin + np.argsort(size[begin:end], kind="stable")
            n, own, sig, prefix = size[order], root[order], sigs[order], chosen[order]
            here = key[begin : begin + 1].view(np.uint64)[0]
            upto = np.searchsorted(n, n * 100 // similarity, side="right")  # larger sets can't be similar enough
            for p in range(len(order) - 1):
                other = np.arange(p + 1, upto[p])
                other = other[own[other] != own[p]]
                other = other[alike(sig[other], sig[p], similarity)]
                if len(other):
                    both = np.isin(prefix[other], prefix[p])
                    other = other[np.where(both, prefix[other], np.iinfo(np.uint64).max).min(axis=1) == here]
                    found[order[other]] = True
                    found[order[p]] |= len(other) > 0
        yield pa.RecordBatch.from_arrays([table.column(c).filter(pa.array(found)).combine_chunks() for c in ("key", "grid", "set_id")], names=["key", "grid", "set_id"])


def forest(batches: Iterator[pa.RecordBatch], shingle: int, similarity: int) -> Iterator[pa.RecordBatch]:
    """``pivot, member``: links between the classes of each list, compared on the full sets of its texts.

    A list gives less links than it has sets, as sets that are joined are not compared any more.
    """
    hashed = word_hashes()
    for table, begins in whole_lists(batches):
        ids, roots, texts = table.column("set_id").to_numpy(), table.column("root").to_numpy(), table.column("text")
        pairs = []
        for begin, end in zip(begins, begins[1:]):
            sets = [shingle_set(texts[int(i)].as_py(), shingle, hashed) for i in range(begin, end)]
            sizes = np.array([len(s) for s in sets])
            starts = np.cumsum(sizes) - sizes
            values, dense = np.unique(np.concatenate(sets), return_inverse=True)
            marked = np.zeros(len(values), dtype=np.int64)
            here, root = ids[begin:end], roots[begin:end].copy()
            for p in range(end - begin):
                open_ = root != root[p]
                open_[:p] = False  # compared already
                if not open_.any():
                    continue
                own = dense[starts[p] : starts[p] + sizes[p]]
                marked[own] = 1
                common = np.add.reduceat(marked[dense], starts)
                marked[own] = 0
                for k in np.flatnonzero(open_ & (100 * common >= similarity * (sizes + sizes[p] - common))):
                    if root[k] != root[p]:
                        root[root == root[k]] = root[p]
                        pairs.append((here[p], here[k]))
        columns = list(zip(*pairs)) if pairs else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["pivot", "member"])


@dataclass(frozen=True)
class Texts:
    """Where the texts of sets are found again: rows ``doc_id, text``, and one row of them for each set."""

    docs: DataFrame  # doc_id, text
    homes: DataFrame  # set_id, no_id, id, source
    shingle: int
    similarity: int

    def of(self, asked: DataFrame) -> DataFrame:
        """The rows with the ``text`` of their ``set_id``; a set that is not asked for is not moved."""
        keys = ["no_id", "id", "source"]
        asked = cut(asked.join(self.homes, "set_id"))
        cells = F.broadcast(asked.select(cell_of("source").alias("cell")).distinct())  # CELLS rows at most
        texts = self.docs.withColumns(row_key()).withColumn("cell", cell_of("source")).join(cells, "cell", "left_semi")
        texts = texts.groupBy(*keys).agg(F.first("text").alias("text"))  # a repeated row once
        return texts.join(asked, keys).drop(*keys)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """``pivot, member``: the distinct pairs whose full sets are similar enough.

        Only texts that a pair needs are moved, each one to the places of its pairs, where its set is made
        again.  A pivot's members are dealt out over salts, and the pivot's text is repeated for each.
        """
        counts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / AT_PIVOT).cast("long").alias("parts"))
        dealt = pairs.join(counts, "pivot").select("pivot", F.pmod(F.xxhash64("member"), F.col("parts")).alias("salt"), "member")
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt")
        leads = counts.select("pivot", salts, F.col("pivot").alias("member"))
        rows = self.of(dealt.unionByName(leads).withColumnRenamed("member", "set_id"))
        rows = rows.select("pivot", "salt", (F.col("set_id") != F.col("pivot")).alias("second"), F.col("set_id").alias("member"), "text")
        order = ["pivot", "salt", "second"]
        spread = rows.repartition(F.col("pivot"), F.col("salt")).sortWithinPartitions(*order)
        shingle, similarity = self.shingle, self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashed, lead, own = word_hashes(), None, None
            for batch in batches:
                found = []
                for pivot, salt, second, member, text in zip(*[c.to_pylist() for c in batch.columns]):
                    here = shingle_set(text, shingle, hashed)
                    if not second:
                        lead, own = (pivot, salt), here
                    elif lead == (pivot, salt):
                        both = len(np.intersect1d(own, here, assume_unique=True))
                        if 100 * both >= similarity * (len(own) + len(here) - both):
                            found.append((pivot, member))
                columns = list(zip(*found)) if found else [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["pivot", "member"])

        return spread.mapInArrow(run, "pivot long, member long")


def cell_of(source: str) -> Column:
    return F.pmod(F.col(source), F.lit(CELLS))


def row_key() -> dict[str, Column]:
    """Names of a row of documents that hold for nulls as well: repeated rows share them."""
    return {"no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "source": F.xxhash64("text")}


def roots_of(sets: DataFrame, texts: Texts) -> DataFrame:
    """``node, root`` of all sets that are linked with another one."""
    counts, similarity, shingle = sets.sparkSession.sparkContext.broadcast(common_cells(sets)), texts.similarity, texts.shingle
    lists = by_list(postings(sets, counts, similarity))
    first = cut(lists.mapInArrow(lambda batches: first_pairs(batches, similarity), "key long, grid long, pivot long, member long"))
    pairs = first.where("pivot IS NOT NULL").select("pivot", "member").distinct()
    links = cut(texts.confirmed(cut(pairs)))
    roots = cut(components(links, "pivot", "member"))
    own = first.where("pivot IS NULL").select("key", "grid", F.col("member").alias("set_id"))
    own = own.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    own = cut(own.join(sets.select("set_id", "n", "sig", "keys"), "set_id").select("key", "grid", "set_id", "n", "sig", "keys", "root"))
    left = cut(by_list(own).mapInArrow(lambda batches: unsettled(batches, counts, similarity), "key long, grid long, set_id long"))
    if left.isEmpty():
        return roots
    rows = texts.of(left.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    rows = by_list(rows.select("key", "grid", "set_id", "root", "text"))
    more = cut(rows.mapInArrow(lambda batches: forest(batches, shingle, similarity), "pivot long, member long"))
    return cut(components(links.unionByName(more), "pivot", "member"))


def similar_documents(
    docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, root``: class of each document under chains of similar sets.

    Two documents are linked if the sets of their word shingles have a Jaccard similarity of
    ``similarity`` percent or more; candidates come from signatures (a pair at the threshold is lost
    with a probability below 2 MISSED), links are confirmed on the full sets.  ``component_id`` is
    the smallest id of the class, ``kept`` says that it is the row's own, ``root`` names the
    class and is null for a text alone without words.  Equal sets fall together before anything is compared.

    A null or empty text, or one of white space, has no shingles and is linked with nothing, not even
    its like; a null id doesn't count as smallest, and is kept if its class has no other;
    repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    if not 0 < similarity <= 100:
        raise ValueError("similarity is a percentage above zero")
    rows = cut(described(docs, shingle, id_col, text_col))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    name = F.struct(*[c.alias(k) for k, c in (row_key() | {"source": F.col("source")}).items()])
    some = rows.where("set_id IS NOT NULL")
    sets = cut(
        some.groupBy("set_id").agg(
            F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min(name).alias("home"),
            F.min("keys").alias("keys"), F.min("sig").alias("sig"),
        )
    )
    roots = roots_of(sets, Texts(plain, sets.select("set_id", "home.*"), shingle, similarity))
    classes = sets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    classes = cut(classes.select("set_id", "copies", "least", F.coalesce("root", "set_id").alias("root")))
    lowest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(classes.join(lowest, "root").select("set_id", "copies", "root", "component_id"))
    total = named.agg(F.sum("copies")).first()[0] or 0
    found = lookup(some.select("doc_id", "n", "set_id"), named.drop("copies"), "set_id", named.select("set_id", F.col("copies").alias("n")), total)
    alone = rows.where("set_id IS NULL").withColumns({"component_id": F.col("doc_id"), "root": F.col("set_id")})
    every = found.select("doc_id", "n", "component_id", "root").unionByName(alone.select("doc_id", "n", "component_id", "root"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root")
