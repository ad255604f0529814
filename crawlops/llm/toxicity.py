"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are scored by their log-odds between toxic and other texts under an informative
Dirichlet prior, from a bounded sample of labelled documents.  A linear scan finds all
maximal segments of each whole text; extreme-value statistics say how unlikely their scores
are in a clean text of that length, and a logistic curve turns that into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlops.llm.segments import maximal
from crawlops.llm.texts import Cache, held, small_batches
from crawlops.session import cut

TRAIN_ROWS = 8_000  # labelled documents that the model is fitted on, at most
MODEL_WORDS = 20_000  # words with scores of their own, at most
PRIOR = 0.05  # weight of the prior: so many tokens for each token counted
CACHED = 200_000  # tokens whose scores a worker keeps
SURE = 2.5  # standard errors that a word's log-odds must differ from zero
EFFECT = 1.0  # least log-odds of a word with a score of its own
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Distinct ``text, toxic`` of at most ``rows`` labelled documents, chosen by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def word_counts(train: DataFrame) -> DataFrame:
    """``word, toxic, n``: how often a word stands in either kind of text, repeats apart.

    That is the number of texts it stands in or of different pairs of words around it,
    whichever is lower: neither a family of copies nor one odd text makes a word frequent.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    parts = F.arrays_zip("w", F.expr("concat(array(''), w)").alias("before"), F.expr("slice(w, 2, size(w))").alias("after"))
    texts = train.select("toxic", F.xxhash64("text").alias("doc"), words.alias("w"))
    spots = texts.select("toxic", "doc", F.explode(parts).alias("p")).where("p.w IS NOT NULL")
    seen = spots.select("toxic", "doc", F.col("p.w").alias("word"), F.xxhash64("p.before", "p.after").alias("near"))
    return seen.groupBy("word", "toxic").agg(F.least(F.count_distinct("doc"), F.count_distinct("near")).alias("n"))


def log_odds(counts: DataFrame, words: int = MODEL_WORDS) -> tuple[dict[str, tuple[float, float]], float]:
    """Words that differ surely: (score, share among clean tokens); and the clean share of all others."""
    total = {r["toxic"]: r["n"] for r in counts.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    n1, n0 = float(total.get(1, 0)), float(total.get(0, 0))
    if not n1 or not n0:
        return {}, 1.0
    table = counts.groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y1"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("y0"),
    )
    prior, all_prior = PRIOR * (F.col("y1") + F.col("y0")), PRIOR * (n1 + n0)
    one, none = F.col("y1") + prior, F.col("y0") + prior
    odds = F.log(one / (n1 + all_prior - one)) - F.log(none / (n0 + all_prior - none))
    error = F.sqrt(1 / one + 1 / none)
    sure = (
        table.select("word", odds.alias("odds"), error.alias("error"), (none / (n0 + all_prior)).alias("share"))
        .where(F.abs("odds") >= F.greatest(SURE * F.col("error"), F.lit(EFFECT)))
        .orderBy(F.desc(F.abs("odds") / F.col("error")), "word")
        .limit(words)
        .collect()
    )
    found = {r["word"]: (math.copysign(abs(r["odds"]) - r["error"], r["odds"]), r["share"]) for r in sure}
    return found, max(1e-9, 1 - sum(share for _, share in found.values()))


def segments(scores: np.ndarray) -> list[float]:
    """Scores of all maximal segments, in one linear scan."""
    return [high - low for _, _, low, high in maximal(scores)]


@dataclass(frozen=True, eq=False)
class Model:
    words: dict[str, float]
    other: float  # score of any other word
    decay: float = 1.0  # of the extreme-value law
    rate: float = 1.0  # segments a clean token begins, at score zero
    shift: float = 0.0
    slope: float = 0.0

    def scorer(self) -> Callable[[str], tuple[int, list[float]]]:
        """Function from a text to its number of tokens and the scores of its segments.

        A token stands between white space and counts as its most toxic word, if it has one.
        """

        def token(chunk: str) -> float:
            found = [self.words.get(w, self.other) for w in WORD.findall(chunk.lower())]
            return max(found) if found and max(found) > 0 else sum(found)

        tokens = held(("toxicity", self), lambda: Cache(token, CACHED))

        def find(text: str) -> tuple[int, list[float]]:
            scores = np.fromiter(map(tokens.__getitem__, text.split()), float)
            return len(scores), segments(scores) if scores.max(initial=0) > 0 else []

        return find

    def evidence(self, size: int, found: list[float]) -> float:
        """Minus the logarithm of the chance of the best few segments in a clean text of ``size`` words."""
        best = total = 0.0
        expected = math.log(self.rate * max(size, 1))
        for count, score in enumerate(sorted(found, reverse=True), 1):
            total += self.decay * score - expected + math.log(count)
            best = max(best, total)
        return best

    def score(self, size: int, found: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.shift + self.slope * math.log1p(self.evidence(size, found))))))


def decay_of(words: dict[str, tuple[float, float]], other: float, share: float) -> float:
    """The positive root of: the mean of exp(decay * score) over clean tokens is one."""
    scores = np.array([other, *(s for s, _ in words.values())])
    shares = np.array([share, *(p for _, p in words.values())])
    if not (scores > 0).any() or (scores * shares).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (shares * np.exp(high * scores)).sum() < 1:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (shares * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Shift and slope by Newton steps with a small ridge."""
    rows, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-rows @ beta))
        slope = rows.T @ (y - p) - 1e-2 * beta
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of the labelled sample; the driver sees its words and, per document, segment scores only."""
    spark = docs.sparkSession
    train = training_texts(docs, labels).persist()
    try:
        words, share = log_odds(cut(word_counts(train)))
        drift = sum(s * p for s, p in words.values() if s > 0)
        other = min(-0.5, -2 * drift / share)  # a clean token scores below zero in the mean
        model = Model({w: s for w, (s, _) in words.items()}, other, decay_of(words, other, share))
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = sent.value.scorer()
            for batch in batches:
                rows = [find(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.float64()))],
                    names=["toxic", "size", "found"],
                )

        rows = train.select("text", "toxic").mapInArrow(run, "toxic int, size long, found array<double>").collect()
    finally:
        train.unpersist()
    clean = [r for r in rows if not r["toxic"]]
    least = min([s for s in model.words.values() if s > 0], default=1.0)
    expected = sum(r["size"] for r in clean) * math.exp(-model.decay * least)
    observed = sum(s >= least for r in clean for s in r["found"])
    model = Model(model.words, other, model.decay, (observed + 0.5) / max(expected, 1.0))
    if not rows or len({r["toxic"] for r in rows}) < 2:
        return model
    evidence = np.array([math.log1p(model.evidence(r["size"], r["found"])) for r in rows])
    shift, slope = logistic(evidence, np.array([float(r["toxic"]) for r in rows]))
    return Model(model.words, other, model.decay, model.rate, shift, slope)


def toxic_score(text: Column | str, model: Model, spark) -> Column:
    """Score of a text between 0 and 1; null counts as empty."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = sent.value.scorer()
        return pa.array([sent.value.score(*found(t or "")) for t in texts.to_pylist()], pa.float64())

    return score(F.col(text) if isinstance(text, str) else text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Labels of held-out ids, null labels and labels of unknown documents are not learnt from.
    A null or empty text is scored as one without words; without labels of both kinds all
    scores are 0.5; repeated rows and null ids (never held out) stay; an empty table gives no
    rows; other columns are not read.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", toxic_score("text", model, docs.sparkSession).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
