"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are ordered from rare to common.  Its prefix is the three rarest ones
(with all that are as common as the third): one edit destroys at most two bigrams, so two
words that are one edit apart share one of their prefixes.  Two disjoint bigrams of the prefix
are the pivots; one edit spoils one of them at most.  So of two such words the one whose
prefix ends earlier in the order has a pivot that the other has in its prefix.

The edit lies on one side of that pivot; on the other side both words are equal, which fixes the pivot's
place in both.  Pivots and prefixes meet by that equal side, by the lengths of both words, and, for a side of
few letters, by the letters at the far end: if the edit had come behind the other pivot, that one would have
found the pair.  What meets is verified.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlops.llm.texts import small_batches
from crawlops.session import cut

LETTERS = "a-z\u00c0-\u00ff"  # of lower-cased texts
LEAST_LENGTH = 7  # code points of a word
LEAST_COUNT = 2
RATIO = 10  # a form is so many times as frequent as the word
DIVISOR = 31
PREFIX = 3  # bigrams: 2 x edits + 1
FAR = 3  # letters at the far end that short sides are keyed with
BASE = np.uint64(0x9E3779B97F4A7C15)
WORDS_HELD = 200_000  # distinct words that a task counts before it hands them on


def distorted(doc: bytes, word: bytes) -> bytes | str:
    """The word as it counts for a document: where 31 divides the checksum, without one code point."""
    h = zlib.crc32(word, zlib.crc32(doc))
    if h % DIVISOR:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: how often each word of at least LEAST_LENGTH code points occurs, LEAST_COUNT times or more.

    Counts are summed in the task first; what a task holds is bounded and handed on when full.
    """
    small_batches(docs.sparkSession)
    # A shorter run can't become a word; a run is found whole, as nothing but its end stops it.
    run_of = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = f"{'' if doc is None else doc}:".encode()
                low = text.encode().lower().decode()  # bytes: only A-Z change
                for word, n in Counter(run_of.findall(low)).items():
                    counts[distorted(prefix, word.encode())] += n
                if len(counts) > WORDS_HELD:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def gram_ranks(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams in the order of their letters, and their places in the order from rare to common; ties by letters.

    There are as many bigrams as pairs of letters (a few thousand), whatever the number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, codes in by_length(batch.column(0)):
                grams, n = np.unique(np.sort(bigrams(codes), axis=1), return_counts=True)
                counts.update(dict(zip(grams.tolist(), n.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    grams = np.array(sorted(r["gram"] for r in found), dtype=np.int64)
    order = sorted(found, key=lambda r: (r["n"], r["gram"]))
    ranks = np.empty(len(grams), dtype=np.int64)
    ranks[np.searchsorted(grams, [r["gram"] for r in order])] = np.arange(len(order))
    return grams, ranks


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their code points as a matrix."""
    texts = words.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes):
        who = np.flatnonzero(sizes == size)
        yield who, np.frombuffer("".join([texts[i] for i in who]).encode("utf-32-le"), dtype="<u4").astype(np.int64).reshape(-1, size)


def bigrams(codes: np.ndarray) -> np.ndarray:
    return codes[:, :-1] << 21 | codes[:, 1:]


def prefix_and_pivots(order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length: the rank at which the prefix ends, which places are in it, and both pivots.

    Among disjoint pairs of the prefix, the one of least total rank is found by going over the places
    from left to right: ``best`` is the rarest bigram of the prefix that ends before the place begins.
    """
    n, size = order.shape
    last = np.partition(order, min(PREFIX, size) - 1, axis=1)[:, min(PREFIX, size) - 1]
    prefix = order <= last[:, None]
    none = np.iinfo(np.int64).max // 4
    ranks = np.where(prefix, order, none)
    best, best_at, total = np.full(n, none), np.zeros(n, dtype=np.int64), np.full(n, 2 * none)
    left, right = prefix.argmax(axis=1), prefix.argmax(axis=1)
    for p in range(2, size):  # bigrams two places apart share no letter
        rarer = ranks[:, p - 2] < best
        best, best_at = np.where(rarer, ranks[:, p - 2], best), np.where(rarer, p - 2, best_at)
        better = (best < none) & (ranks[:, p] < none) & (best + ranks[:, p] < total)
        total = np.where(better, best + ranks[:, p], total)
        left, right = np.where(better, best_at, left), np.where(better, p, right)
    return last, prefix, left, right


class Sides:
    """Hashes of what stands before or behind places of words of one length."""

    def __init__(self, codes: np.ndarray):
        self.size = codes.shape[1]
        self.sums = np.zeros((len(codes), self.size + 1), dtype=np.uint64)
        self.powers = np.ones(self.size + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            self.powers[1:] = np.multiply.accumulate(np.full(self.size, BASE))
        for j in range(self.size):
            self.sums[:, j + 1] = self.sums[:, j] * BASE + codes[:, j].astype(np.uint64)

    def part(self, who: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.sums[who, end] - self.sums[who, begin] * self.powers[end - begin]

    def key(self, behind: int, who: np.ndarray, place: np.ndarray, far: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Of the bigram and all before it (or ``behind`` it), ``far`` letters at the other end, and a length."""
        zero, end = np.zeros_like(place), np.full_like(place, self.size)
        near = self.part(who, place, end) if behind else self.part(who, zero, place + 2)
        rest = self.part(who, zero, far) if behind else self.part(who, end - far, end)
        h = (near * BASE + rest) * BASE + (other * 64 + far * 2 + behind).astype(np.uint64)
        return h ^ (h >> np.uint64(31))


def gram_rows(words: DataFrame, ranks: tuple[np.ndarray, np.ndarray], pivots: bool) -> DataFrame:
    """``key, word, last``: what pivots ask for in the other word, or what the bigrams of the prefix offer.

    ``last`` is the rank at which the prefix of the word ends.
    """
    held = words.sparkSession.sparkContext.broadcast(ranks)

    def asked(sides: Sides, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        who, none, size = np.arange(len(left)), np.zeros_like(left), sides.size
        for longer in (-1, 0, 1):
            other = np.full_like(left, size + longer)
            # An edit behind the left pivot is not behind the right one: else that one finds the pair.
            yield who, sides.key(0, who, left, np.minimum(FAR, np.maximum(size - right - 2, 0)), other)
            yield who, sides.key(0, who, right, none, other)
            yield who, sides.key(1, who, left, none, other)
            yield who, sides.key(1, who, right, np.minimum(FAR, left), other)

    def offered(sides: Sides, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        who, place = np.nonzero(prefix)
        for far in range(FAR + 1):
            for behind, room in ((0, sides.size - place - 2), (1, place)):
                fits = room >= far
                own, at = who[fits], place[fits]
                yield own, sides.key(behind, own, at, np.full_like(at, far), np.full_like(at, sides.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rank = held.value
        for batch in batches:
            for places, codes in by_length(batch.column(0)):
                last, prefix, left, right = prefix_and_pivots(rank[np.searchsorted(grams, bigrams(codes))])
                sides = Sides(codes)
                for who, keys in asked(sides, left, right) if pivots else offered(sides, prefix):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(places[who])), pa.array(last[who])], names=["key", "word", "last"]
                    )

    return words.select("word").mapInArrow(run, "key long, word string, last long")


def near_words(words: DataFrame) -> DataFrame:
    """``word, other``: all ordered pairs of distinct words that differ by one inserted, deleted or replaced code point.

    ``words`` holds distinct ``word`` of at least five code points.
    """
    ranks = gram_ranks(words)
    a, b = gram_rows(words, ranks, True).alias("a"), gram_rows(words, ranks, False).alias("b")
    earlier = (F.col("a.last") <= F.col("b.last")) & (F.col("a.word") != F.col("b.word"))
    near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    found = a.join(b, [F.col("a.key") == F.col("b.key"), earlier, near])
    pairs = found.select(F.least("a.word", "b.word").alias("low"), F.greatest("a.word", "b.word").alias("high"))
    both = F.array(F.struct(F.col("low").alias("word"), F.col("high").alias("other")), F.struct(F.col("high").alias("word"), F.col("low").alias("other")))
    return pairs.distinct().select(F.explode(both).alias("p")).select("p.*")


def variants(counts: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the more frequent spelling that each word is a variant of.

    ``counts`` holds distinct ``word`` with ``n``.  ``form`` is the nearest frequent spelling, one edit away and
    at least RATIO times as frequent; ``root`` is where the forms end.  A form is always more
    frequent than its word, so a chain is never longer than the digits of the largest count.
    """
    words = cut(counts.select("word", "n"))
    pairs = near_words(words)
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("form")))
    found = pairs.join(other, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.rank") >= RATIO * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.rank")).alias("n"))).alias("to"),
    )
    rows = cut(rows.select("word", F.col("to.form").alias("form"), "n", "n_near", F.col("to.n").alias("form_n")))
    most = rows.agg(F.max("n")).first()[0] or 1
    steps = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(len(str(most)) + 1))):  # each round doubles the steps that are gone
        later = steps.select(F.col("word").alias("root"), F.col("root").alias("later"))
        steps = cut(steps.join(later, "root", "left").select("word", F.coalesce("later", "root").alias("root")))
    return rows.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of all words of whole texts.

    Null and empty texts have no words; a null id counts as an empty one in the checksum; repeated
    rows count each time; a run may be as long as its text; of equally frequent near words the
    first in code-point order is the form; an empty table gives no rows; other columns are not
    read.
    """
    return variants(word_counts(docs, id_col, text_col))
