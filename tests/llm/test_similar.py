"""Similar documents, spelling variants and whitening against brute force."""

import collections
import decimal
import fractions
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlops.llm import minhash_join, queries, spelling, whitening
from crawlops.llm.minhash_join import COORDINATES, least_matches, shingle_set, signature, similar_documents, whole_lists, word_hashes
from crawlops.llm.spelling import near_words, prefix_and_pivots, spelling_variants, variants
from crawlops.llm.whitening import refined, whiten
from tests.conftest import SMALL
from tests.llm.conftest import ODD

DOC = "doc_id long, text string"


def plain_sets(docs, size=2):
    for doc, text in docs:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall("[^\x20\x09-\x0d]+", low)
        yield doc, {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_classes(docs, size=2, percent=80):
    """``doc_id, n_shingles, component_id, kept`` of each row, by comparing all pairs."""
    every = list(plain_sets(docs, size))
    root = list(range(len(every)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(every):
        for j, (_, b) in enumerate(every[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    low = collections.defaultdict(list)
    for i, (doc, _) in enumerate(every):
        low[top(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in low.items()}
    return collections.Counter((doc, len(s), least[top(i)], doc == least[top(i)]) for i, (doc, s) in enumerate(every))


def classes(found):
    return collections.Counter(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_similar_odd(odd, nothing):
    assert classes(similar_documents(odd)) == plain_classes([(r[0], r[1]) for r in ODD])
    assert classes(similar_documents(odd, 1, 50)) == plain_classes([(r[0], r[1]) for r in ODD], 1, 50)
    assert similar_documents(nothing).count() == 0
    assert similar_documents(nothing).columns == ["doc_id", "n_shingles", "component_id", "kept", "root"]


def edited(words, dice, edits):
    out = list(words)
    for at in dice.choice(len(out), edits, replace=False):
        out[at] = f"e{dice.integers(1 << 40)}"
    return " ".join(out)


def crowd():
    """Copies of three texts with few edits, chains of edits, and many texts that share half their words."""
    dice = np.random.default_rng(4)
    base = [[f"w{dice.integers(1 << 30)}" for _ in range(n)] for n in (120, 90, 60)]
    docs = [edited(b, dice, int(dice.integers(0, 9))) for b in base for _ in range(90)]
    step = list(base[0])
    for _ in range(12):
        step = edited(step, dice, 4).split()
        docs.append(" ".join(step))
    docs += [" ".join(base[1][:60] + [f"u{dice.integers(1 << 40)}" for _ in range(k % 40)]) for k in range(120)]
    return [(i, t) for i, t in enumerate(docs, 1)] + [(7, docs[3]), (None, docs[4]), (None, docs[5]), (9000, docs[100]), (9001, "")]


@pytest.mark.parametrize("cut_at", [1024, 16])
def test_similar_crowd(spark, monkeypatch, cut_at):
    monkeypatch.setattr(minhash_join, "CROWD", cut_at)
    docs = crowd()
    assert classes(similar_documents(spark.createDataFrame(docs, DOC).repartition(5))) == plain_classes(docs)


def test_lists_are_cut_between_batches():
    dice = np.random.default_rng(1)
    key = np.sort(dice.integers(0, 30, 400))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(key % 2), pa.array(np.arange(400))], names=["key", "grid", "x"])
    cuts = np.sort(dice.integers(0, 401, 60))
    parts = [rows.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, 400])]
    found = [t.slice(a, b - a) for t, begins in whole_lists(iter(parts)) for a, b in zip(begins, begins[1:])]
    assert [set(t.column("key").to_pylist()) for t in found] == [{k} for k in sorted(set(key.tolist()))]
    assert [x for t in found for x in t.column("x").to_pylist()] == list(range(400))


def test_match_thresholds():
    for size in (minhash_join.POSTED, COORDINATES):
        t = least_matches(size)
        lost = [sum(math.comb(size, k) * 0.8**k * 0.2 ** (size - k) for k in range(m)) for m in (t, t + 1)]
        assert lost[0] <= minhash_join.MISSED < lost[1]


def test_signatures_agree_as_sets_do():
    dice = np.random.default_rng(2)
    agreed = []
    for _ in range(300):
        both = dice.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = both[:90], np.concatenate([both[10:]])
        agreed.append((signature(np.unique(a)) == signature(np.unique(b))).sum())
    assert abs(np.mean(agreed) / COORDINATES - 0.8) < 0.01
    assert abs(np.var(agreed) / (COORDINATES * 0.16) - 1) < 0.25 and min(agreed) >= least_matches(COORDINATES)


def test_shingle_sets():
    hashed = word_hashes()
    for text in ("", " \t", "a", "A b", "a b a b", "É é"):
        assert len(shingle_set(text, 2, hashed)) == len(next(plain_sets([(1, text)]))[1])
    assert set(shingle_set("A b c", 2, hashed)) == set(shingle_set("b c a b", 2, hashed)) - set(shingle_set("c a", 2, hashed))
    assert set(shingle_set("a", 2, hashed)).isdisjoint(shingle_set("a a", 2, hashed))


def plain_variants(docs):
    counts = collections.Counter()
    for doc, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            at = h % len(word)
            counts[word[:at] + word[at + 1 :] if h % 31 == 0 else word] += 1
    return plain_forms({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_forms(n):
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 10 * n[w] else None for w, b in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def forms(found):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}


def test_variants_odd(odd, nothing, spark, monkeypatch):
    assert forms(spelling_variants(odd)) == plain_variants([(r[0], r[1]) for r in ODD])
    assert spelling_variants(nothing).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling_variants(nothing).count() == 0
    monkeypatch.setattr(spelling, "WORDS_HELD", 3)
    small = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    docs = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert forms(spelling_variants(small)) == plain_variants(docs)


def test_chains_and_ties(spark):
    n = {"abcdefgh": 100_000, "abcdefg": 5_000, "abcdefx": 5_000, "abcdex": 7, "abcdefgg": 400, "abcdefggg": 39, "abcdefgggg": 2, "zzzzzzzz": 3, "zzzzzzzzz": 30}
    n |= {"abcdexgh": 10_000, "ÀBÿbbbbb": 2, "Àbÿbbbbb": 20, "aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaab": 500}
    assert forms(variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_forms(n)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=7, max_size=10), min_size=2, max_size=40), st.randoms())
def test_pivots_meet_prefixes(words, dice):
    """Whatever the order of the bigrams, of two words one edit apart one asks for a key that the other offers."""
    words = list(dict.fromkeys(words))
    for word in words[:10]:
        at = dice.randrange(len(word))
        words += [word[:at] + word[at + 1 :], word[:at] + dice.choice("abc") + word[at + 1 :]]
    words = [w for w in dict.fromkeys(words) if len(w) >= 6]
    grams = np.unique(np.concatenate([spelling.bigrams(c).ravel() for _, c in spelling.by_length(pa.array(words))]))
    ranks = np.array(dice.sample(range(len(grams)), len(grams)))
    asked, offered, last = collections.defaultdict(set), collections.defaultdict(set), {}

    class Held:
        value = (grams, ranks)

    class Frame:
        """Runs a function on Arrow batches here."""

        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda _: Held)})})

        def select(self, _):
            return self

        def mapInArrow(self, run, _):
            return run(iter([pa.RecordBatch.from_arrays([pa.array(words)], names=["word"])]))

    for found, pivots in ((asked, True), (offered, False)):
        for batch in spelling.gram_rows(Frame(), None, pivots):
            for key, word, rank in zip(*[c.to_pylist() for c in batch.columns]):
                found[word].add(key)
                last[word] = rank
    for _, codes in spelling.by_length(pa.array(words)):
        order = ranks[np.searchsorted(grams, spelling.bigrams(codes))]
        end, prefix, left, right = prefix_and_pivots(order)
        for row, mask, i, k in zip(order.tolist(), prefix, left, right):
            chosen = np.flatnonzero(mask).tolist()
            assert k - i >= 2 and {i, k} <= set(chosen) and len(chosen) >= 3
            assert row[i] + row[k] == min(row[p] + row[q] for p in chosen for q in chosen if q - p >= 2)
    for a in words:
        for b in words:
            if one_edit(a, b):
                first, second = sorted((a, b), key=last.__getitem__)
                assert asked[first] & offered[second]


def test_near_words_of_a_crowd(spark):
    dice = np.random.default_rng(3)
    words = list({"".join(dice.choice(list("abcé"), 7 + int(k))) for k in dice.integers(0, 3, 700)})
    found = {tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


NAN, INF = float("nan"), float("inf")
VECTOR = "vec_id long, embedding array<float>, n string, vector int, whitened double"


def vector_rows(vectors):
    return [(i, v, "n", 3, 0.5) for i, v in vectors]


def plain_whitened(vectors, count):
    """Exact sums and covariance, double-precision eigenvectors."""
    size = max(map(len, vectors))
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (size - len(v)) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = [[n * c - s for c, s in zip(row, sums)] for row in x]
    cov = np.array([[float(fractions.Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(size)] for i in range(size)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    return [sum(c * c for c in row) for row in d], np.array(d, dtype=float) / n @ axes / np.sqrt(values), values / np.trace(cov)


def test_whitening_odd(spark):
    dice = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in dice.normal(size=4) * [1, 2, 5, 9]]) for i in range(40)]
    good += [(40, [1.5, 2.5]), (None, good[3][1]), (5, good[5][1]), (5, good[5][1]), (41, []), (42, [1e6, -3.0, 0.25, 8.0])]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [NAN, 1.0, 1.0, 1.0]), (53, [INF, 1.0, 1.0, 1.0])]
    found = whiten(spark.createDataFrame(vector_rows(good + bad), VECTOR).repartition(3)).collect()
    deep, white, explained = plain_whitened([v for _, v in good], 4)
    got = sorted((str(r["vec_id"]), int(r["deviation"])) for r in found)
    assert got == sorted((str(i), d) for (i, _), d in zip(good, deep))
    by_id = {r["vec_id"]: r for r in found}
    assert {r["n"] for r in found} == {len(good)} and len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    signs = np.sign(np.array(by_id[0]["whitened"]) * white[0])
    for k, (i, _) in enumerate(good):
        assert np.allclose(by_id[i]["whitened"] * signs, white[k], rtol=1e-9, atol=1e-9)
    assert np.allclose(found[0]["explained"], explained, rtol=1e-9)


def test_whitening_without_variance(spark):
    empty = whiten(spark.createDataFrame([], VECTOR))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(spark.createDataFrame(vector_rows([(1, None), (2, [NAN])]), VECTOR)).count() == 0
    same = whiten(spark.createDataFrame(vector_rows([(1, [1.0, 2.0]), (2, [1.0, 2.0])]), VECTOR)).collect()
    assert [(r["vec_id"], r["whitened"], r["explained"], int(r["deviation"])) for r in same] == [(1, [], [], 0), (2, [], [], 0)]
    flat = whiten(spark.createDataFrame(vector_rows([(1, [1.0, 2.0, 7.0]), (2, [3.0, 2.0, 9.0]), (3, [2.0, 2.0, 8.0])]), VECTOR)).collect()
    assert {len(r["whitened"]) for r in flat} == {1} and flat[0]["identity_error"] < 1e-9 and abs(flat[0]["explained"][0] - 1) < 1e-12


def test_whitening_of_large_numbers(spark):
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(np.random.default_rng(6).normal(size=(30, 3)) * [1e13, 2e13, 3e12])]
    found = {r["vec_id"]: r for r in whiten(spark.createDataFrame(vector_rows(vectors), VECTOR)).collect()}
    deep, white, _ = plain_whitened([v for _, v in vectors], 3)
    assert [found[i]["deviation"] for i, _ in vectors] == [decimal.Decimal(d) for d in deep] and max(deep) > 1 << 63
    signs = np.sign(np.array(found[0]["whitened"]) * white[0])
    assert all(np.allclose(found[i]["whitened"] * signs, white[i], rtol=1e-9, atol=1e-9) for i, _ in vectors)
    assert whiten(spark.createDataFrame(vector_rows([(1, [3e38]), (2, [-3e38])]), VECTOR)).count() == 2


@pytest.mark.parametrize("values", [
    [1, 1 + 1e-9, 1 + 2e-9, 2, 3], [5, 5, 5, 1, 1], [100, *[60 + 1e-7 * i for i in range(20)]], [1e-12, 1e-6, 1, 1e3], [0, 0, 7], [3], [0, 0],
])
def test_refined_eigenvectors(values):
    """Orthogonal and diagonal beyond what single precision gives, close values told apart by sub-solves."""
    size = len(values)
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(size, size)))[0].astype(np.longdouble)
    for _ in range(3):
        turn = turn @ (np.eye(size) * np.longdouble(1.5) - turn.T @ turn / 2)
    a = turn @ np.diag(np.array(values, dtype=np.longdouble)) @ turn.T
    found, axes = refined((a + a.T) / 2)
    wide, scale = axes.astype(np.longdouble), max(max(values), 1e-300)
    assert np.abs(wide.T @ wide - np.eye(size)).max() < 1e-15
    assert np.abs(a @ wide - wide * found).max() < 2e-15 * scale
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-15 * scale * size
    order = np.argsort(-np.array(values), kind="stable")
    for k, v in enumerate(np.sort(values)[::-1]):
        if (np.abs(np.array(values) - v) < 1e-10 * scale).sum() == 1:
            assert abs(abs(float(turn[:, order[k]] @ wide[:, k])) - 1) < 1e-15


def test_queries_of_small_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert classes(queries.op11(spark, SMALL)) == plain_classes(docs)
    assert forms(queries.op12(spark, SMALL)) == plain_variants(docs)
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()
    _, white, explained = plain_whitened([r[0] for r in vectors], 32)
    found = np.full((len(vectors), 32), np.nan)
    for r in queries.op13(spark, SMALL).collect():
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10 and r["identity_error"] < 1e-10
    assert np.abs(found * np.sign(found[0] * white[0]) - white).max() < 1e-9
