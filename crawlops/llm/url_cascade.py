"""URL filtering by a cascade of Bloom filters, exact over the keys of the corpus.

The first filter holds the listed keys.  The second holds the other keys of the corpus that
the first one wrongly accepts, the third the listed keys that the second one wrongly accepts,
and so on until no key is wrong.  A key then is listed if the first level that rejects it is
an even one.  Every key of the corpus takes part in building, so no answer about the corpus
is wrong, and asking needs no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlops.session import cut

SHARD_KEYS = 1 << 22  # listed keys of one cascade, about 10 MB of filters
SHARDS_HELD = 8  # cascades that one pass over the pages keeps in memory
LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        own = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(rule.fits(host, path), own).otherwise(found)
    return found


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # bytes
    size: int
    probes: int


def probes(first: np.ndarray, second: np.ndarray, level: int, size: int, count: int) -> Iterator[np.ndarray]:
    """Places of keys, given by two hashes, in the filter of a level."""
    with np.errstate(over="ignore"):
        for i in range(count):
            mixed = first + second * np.uint64(2 * (level * 32 + i) + 1)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(11)) % np.uint64(size)


def accepted(level: Level, depth: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    yes = np.ones(len(first), dtype=bool)
    for at in probes(first, second, depth, level.size, level.probes):
        yes &= (level.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return yes


def listed(levels: list[Level], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether keys are listed: they are rejected first by an even level, counted from one."""
    undecided, answer = np.arange(len(first)), np.zeros(len(first), dtype=bool)
    for depth, level in enumerate(levels):
        yes = accepted(level, depth, first[undecided], second[undecided])
        answer[undecided[~yes]] = depth % 2 == 1
        undecided = undecided[yes]
    answer[undecided] = len(levels) % 2 == 1
    return answer


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("first"), F.xxhash64(key, F.lit(1)).alias("second")]


def columns(batch: pa.RecordBatch, *places: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in places]


def build_level(keys: DataFrame, depth: int, size: int, count: int) -> Level:
    """A filter of some (first, second); tasks find the bits, bytes are put together by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(probes(*columns(batch, 0, 1), depth, size, count))))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(5)).astype(np.int64)), pa.array(np.int64(1) << (at & np.uint64(31)).astype(np.int64))],
                names=["place", "bit"],
            )

    words = keys.select("first", "second").mapInArrow(run, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("word"))
    bits = np.zeros(-(-size // 32), dtype=np.uint32)
    found = words.toArrow()
    bits[found.column("place").to_numpy()] = found.column("word").to_numpy().astype(np.uint32)
    return Level(bits.view(np.uint8), size, count)


def wrongly(keys: DataFrame, level: Level, depth: int) -> DataFrame:
    """Those keys that a filter accepts."""
    held = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(accepted(held.value, depth, *columns(batch, 0, 1))))

    return cut(keys.mapInArrow(run, "first long, second long"))


def build_cascade(keys: DataFrame) -> list[Level]:
    """Levels for distinct keys (first, second, listed); ``listed`` keys number SHARD_KEYS or about that."""
    own = {yes: keys.where(F.col("listed") == yes).select("first", "second") for yes in (True, False)}
    n = {yes: df.count() for yes, df in own.items()}
    levels: list[Level] = []
    for depth in range(LEVELS):
        inside = depth % 2 == 0
        if not n[inside]:
            return levels
        rate = min(0.5, math.sqrt(0.5) * n[True] / max(n[False], 1)) if depth == 0 else 0.5
        count = max(1, round(-math.log2(rate)))
        level = build_level(own[inside], depth, max(64, math.ceil(n[inside] * count / math.log(2))), count)
        levels.append(level)
        own[not inside] = wrongly(own[not inside], level, depth)
        n[not inside] = own[not inside].count()
    raise ValueError("two different keys have the same hashes")


@dataclass
class Cascades:
    """One cascade for each part of the keys; parts are taken by a third hash."""

    levels: list[list[Level]]

    def flag(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """Rows with a flag that says whether the key is listed, in passes of a few cascades."""
        shards = len(self.levels)
        for begin in range(0, max(shards, 1), SHARDS_HELD):
            parts = dict(enumerate(self.levels[begin : begin + SHARDS_HELD], begin))
            ask = asking(df.sparkSession, parts)
            shard = F.pmod(F.xxhash64(F.col(key), F.lit(2)), F.lit(max(shards, 1)))
            answer = ask(*hashes(F.col(key)), shard)
            if begin:
                df = cut(df).withColumn(name, F.col(name) | answer)
            else:
                df = df.withColumn(name, answer)
        return df


def asking(spark: SparkSession, parts: dict[int, list[Level]]):
    held = spark.sparkContext.broadcast(parts)

    @F.arrow_udf("boolean")
    def ask(first: pa.Array, second: pa.Array, shard: pa.Array) -> pa.Array:
        one, two = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in (first, second))
        own, out = shard.to_numpy(zero_copy_only=False), np.zeros(len(one), dtype=bool)
        for part, levels in held.value.items():
            rows = np.flatnonzero(own == part)
            out[rows] = listed(levels, one[rows], two[rows])
        return pa.array(out)

    return ask


def cascades(universe: DataFrame, flag: str = "listed", key: str = "key", shard_keys: int = SHARD_KEYS) -> Cascades:
    """Cascades over all distinct keys of the corpus with their flags."""
    keys = cut(universe.select(*hashes(F.col(key)), F.xxhash64(F.col(key), F.lit(2)).alias("third"), F.col(flag).alias("listed")))
    shards = max(1, -(-keys.where("listed").count() // shard_keys))
    return Cascades([build_cascade(keys.where(F.pmod("third", F.lit(shards)) == s)) for s in range(shards)])


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every url.

    A rule fits its host and all hosts below it if the path starts with the rule's; the
    longest one decides.  Hosts of which the rules block more pages than they allow are the
    list; pages that no rule fits are blocked if their host is listed.  The list is asked
    through cascades over all hosts of the pages.

    A null url or one without :// has an empty host and path; repeated rows and null ids stay;
    an empty table gives no rows; other columns are not read.
    """
    url = F.col(url_col)
    plain = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    ruled = plain.withColumn("found", longest_rule(rules, F.col("host"), F.col("path")))
    surplus = F.coalesce(F.sum(F.when(F.col("found.verdict") == "block", 1).when(F.col("found.verdict") == "allow", -1)), F.lit(0))
    hosts = ruled.groupBy("host").agg((surplus > 0).alias("listed"))
    asked = cascades(hosts, key="host").flag(ruled, "host", "listed")
    verdict = F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return asked.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
