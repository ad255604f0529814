"""Near-duplicate classes, fingerprints and components against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crawlops.llm import components as parts
from crawlops.llm import golay, queries, simhash_dedup
from crawlops.llm.fingerprints import edited_fingerprints, fingerprints, within_radius
from crawlops.llm.simhash_dedup import distance, forest, keys_of, linked, links, near_duplicates, signed
from tests.conftest import SMALL, rows
from tests.llm.conftest import ODD


def plain_print(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def plain_classes(prints, radius=4):
    """Smallest id reachable from each (id, fingerprint)."""
    low = {}
    for start in set(prints):
        seen, front = {start[1]}, [start[1]]
        while front:
            here = front.pop()
            new = {p for _, p in prints if (p ^ here).bit_count() <= radius} - seen
            seen |= new
            front += new
        low[start[1]] = min((i for i, p in prints if p in seen and i is not None), default=None)
    return [(i, p, low[p]) for i, p in prints]


def test_golay_is_perfect():
    words = np.random.default_rng(0).integers(0, 1 << 23, 400)
    near = golay.near_codewords(words)
    assert (near[:, 0] >= 0).all() and set((near >= 0).sum(axis=1)) <= {1, 6}
    codewords = np.array([w for w in range(1 << 23)])[golay.remainders(np.arange(1 << 23)) == 0]
    assert len(codewords) == 4096
    for word, found in zip(words[:40], near):
        wanted = codewords[np.bitwise_count(codewords ^ word) <= 4] >> 11
        assert sorted(found[found >= 0]) == sorted(wanted)


def test_words_two_apart_share_a_codeword():
    dice = np.random.default_rng(1)
    for _ in range(3000):
        word = int(dice.integers(0, 1 << 23))
        other = word ^ sum(1 << int(b) for b in dice.choice(23, dice.integers(0, 3), replace=False))
        a, b = golay.near_codewords(np.array([word, other]))
        assert set(a[a >= 0]) & set(b[b >= 0])


def test_prints_four_apart_share_a_key():
    dice = np.random.default_rng(2)
    for _ in range(1500):
        one = int(dice.integers(0, 1 << 63)) * 2 + int(dice.integers(0, 2))
        other = one ^ sum(1 << int(b) for b in dice.choice(64, dice.integers(0, 5), replace=False))
        keys, who = keys_of(np.array([signed(one), signed(other)], dtype=np.int64))
        assert set(keys[who == 0]) & set(keys[who == 1])


def clustered(seed, n=300):
    dice = np.random.default_rng(seed)
    centres = [int(x) for x in dice.integers(0, 1 << 63, 12)]
    out = {0}
    for _ in range(n):
        base = centres[int(dice.integers(0, 12))]
        out.add(base ^ sum(1 << int(b) for b in dice.choice(64, dice.integers(0, 6), replace=False)))
    return [signed(x) for x in out]


@pytest.mark.parametrize("crowd", [1 << 16, 4])
def test_links_connect_what_is_connected(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    monkeypatch.setattr(simhash_dedup, "SAMPLED", 1)
    found = clustered(7)
    edges = links(spark.createDataFrame([(x,) for x in found], "fp long")).collect()
    mask = (1 << 64) - 1
    assert all((r["a"] & mask ^ r["b"] & mask).bit_count() <= 4 and r["a"] != r["b"] for r in edges)
    wanted = plain_classes([(x, x & mask) for x in found])
    reached = {x: x for x in found}
    for _ in found:
        for r in edges:
            low = min(reached[r["a"]], reached[r["b"]])
            reached[r["a"]] = reached[r["b"]] = low
    assert sorted(collections.Counter(reached.values()).values()) == sorted(collections.Counter(w for _, _, w in wanted).values())


def test_large_groups_are_linked_by_a_forest():
    import pyarrow as pa

    fps = np.array(sorted(clustered(3, 500)), dtype=np.int64)
    pairs = [p for a, b in forest(fps, 4) for p in zip(a, b)]
    assert len(pairs) < len(fps) and all(distance(np.array([a]), np.array([b]))[0] <= 4 for a, b in pairs)
    zeros = np.zeros(len(fps), dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(zeros), pa.array(zeros), pa.array(fps)], names=["key", "grid", "fp"])
    split = [batch.slice(i, 7) for i in range(0, len(fps), 7)]
    assert sum(b.num_rows for b in linked(iter(split), 4)) == len(pairs)


def test_classes_of_table(spark):
    texts = [(r["doc_id"], plain_print(r["text"])) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    wanted = sorted((i, f"{p:016x}", low) for i, p, low in plain_classes(texts))
    assert rows(queries.QUERIES["op8_simhash_dedup"](spark, SMALL), "doc_id", "fingerprint", "component_id") == sorted(wanted, key=repr)


def test_classes_of_odd_rows(odd, nothing):
    wanted = sorted([(i, signed(p), low) for i, p, low in plain_classes([(r[0], plain_print(r[1])) for r in ODD])], key=repr)
    assert rows(near_duplicates(odd), "doc_id", "fp", "component_id") == wanted
    assert near_duplicates(nothing).count() == 0


def test_lookup_of_crowded_keys(spark):
    rows_ = spark.range(300).select((F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id"))).alias("k"), "id")
    sizes, table = rows_.groupBy("k").agg(F.count(F.lit(1)).alias("n")), rows_.select("k", (F.col("k") * 2).alias("v")).distinct()
    assert rows(parts.lookup(rows_, table, "k", sizes, 300)) == rows(rows_.join(table, "k"))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = chain + star + [(200, 201), (201, 200), (300, 300)]
    found = parts.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = collections.defaultdict(set)
    for r in found:
        groups[r["root"]].add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(100, 160)), [200, 201]]
    assert parts.components(spark.createDataFrame([], "a long, b long")).count() == 0


def term_print(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    total, votes = 0, [0] * 64
    for i in range(len(words)):
        term = words[i : i + 3]
        value, weight = 42, 1 + sum(map(len, term)) // 8
        for word in term:
            value = xxhash.xxh64_intdigest(word.encode(), value)
        total += weight
        votes = [v + weight * (value >> b & 1) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if 2 * v > total)


def plain_edits(docs):
    """Expected rows of (doc_id, text), ordered by id with nulls first, then by text."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    for (doc, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        a, b, c = term_print(text), term_print(edited), term_print(after)
        yield (
            doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}",
            1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64,
        )


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_edits_of_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows(queries.QUERIES["op9_fingerprints"](spark, SMALL), *COLUMNS) == sorted(plain_edits(docs), key=repr)


def test_edits_of_odd_rows(spark, odd, nothing, monkeypatch):
    from crawlops.llm import fingerprints as module

    monkeypatch.setattr(module, "ROWS", 1)
    assert rows(edited_fingerprints(odd), *COLUMNS) == sorted(plain_edits([(r[0], r[1]) for r in ODD]), key=repr)
    assert edited_fingerprints(nothing).count() == 0
    one = spark.createDataFrame([(5, "one text only, on its own")], "doc_id long, text string")
    assert rows(edited_fingerprints(one), *COLUMNS) == list(plain_edits([(5, "one text only, on its own")]))
    far = [(i * 10**15, f"text number {i}") for i in range(40)] + [(i, f"close {i}") for i in range(300)]
    docs = spark.createDataFrame(far, "doc_id long, text string")
    assert rows(edited_fingerprints(docs), *COLUMNS) == sorted(plain_edits(far), key=repr)


def test_edits_use_built_in_functions(spark):
    plan = edited_fingerprints(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning") <= 2


def test_neighbours_within_radius(spark):
    found = clustered(11, 150)
    prints = spark.createDataFrame([(x,) for x in found], "fp long")
    asked = prints.where("fp % 5 = 0")
    mask = (1 << 64) - 1
    for radius, blocks in ((3, 6), (2, 5)):
        near = [(q, x, (q & mask ^ x & mask).bit_count()) for q in found if q % 5 == 0 for x in found]
        wanted = sorted([n for n in near if n[2] <= radius], key=repr)
        assert rows(within_radius(prints, asked, radius, blocks), "query", "fp", "distance") == wanted


def test_equal_texts_have_equal_prints(odd):
    found = rows(fingerprints(odd), "doc_id", "fp")
    assert (2, 0) in found and (3, 0) in found and (None, 0) in found
