"""Token counts, prefix encoding and packing against the tokenizers library."""

import collections
import hashlib
import math
import random
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crawlops.llm import queries
from crawlops.llm.config_lp import best_fit, fractional, knapsack, pack, programmed
from crawlops.llm.packing import pack_documents
from crawlops.llm.prefix_bpe import coder, encode_decode, encoded
from crawlops.llm.token_counts import counter, token_counts
from tests.conftest import SMALL, rows
from tests.llm.conftest import ODD

BYTES = Tokenizer.from_file(queries.BYTE_BPE)
WORDS = Tokenizer.from_file(queries.WORD_BPE)
COUNTER, CODER = counter(queries.BYTE_BPE), coder(queries.WORD_BPE)
PARTS = ["<|endoftext|>", "<|startoftext|>", "  ", " ", "\n", "\t", "'s", "'LL", "é", "É", "Σ", "ß", "日本", "12", "a", "the", "thing", "İ", "́", "\x1c", "!!", "🙂", "xx", "ab" * 20]


def word_ids(text):
    return WORDS.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_odd_strings_as_the_library(text):
    assert COUNTER(text) == len(BYTES.encode(text, add_special_tokens=False).ids)
    code, ids = CODER, word_ids(text)
    assert code.encode(text) == packed(ids)
    assert code.both(text)[1] == code.decode(packed(ids)) == WORDS.decode(ids, skip_special_tokens=False)


def test_letters_of_all_blocks():
    for first in range(0x20, 0x2FFF, 61):
        text = " ".join(chr(c) * 2 + "a" for c in range(first, first + 61))
        assert COUNTER(text) == len(BYTES.encode(text, add_special_tokens=False).ids)


def test_counts_of_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.QUERIES["op4_token_counts"](spark, SMALL).collect():
        n = len(BYTES.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 512)


def test_codes_of_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_prefix_bpe"](spark, SMALL).collect():
        ids = word_ids(texts[r["doc_id"]])
        text = WORDS.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(odd, nothing):
    wanted = sorted([(r[0], len(BYTES.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD], key=repr)
    assert rows(token_counts(odd, queries.BYTE_BPE), "doc_id", "n_tokens") == wanted
    wanted = sorted([(r[0], word_ids(r[1])) for r in ODD], key=repr)
    assert rows(encoded(odd, queries.WORD_BPE), "doc_id", "ids") == wanted
    assert encode_decode(odd, queries.WORD_BPE).count() == len(ODD)
    for operator in (token_counts, encode_decode, pack_documents):
        assert operator(nothing, queries.WORD_BPE).count() == 0


def check_pieces(found, texts, capacity=4096):
    """``texts``: (doc_id, text) rows; pieces hold exactly their ids and lie gapless in sequences."""
    pieces = collections.Counter()
    for doc, text in texts:
        ids = [*word_ids(text), 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            pieces[doc, piece, at, len(own), zlib.crc32(packed(own))] += 1
    assert pieces == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    by_sequence = collections.defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = queries.QUERIES["op1_best_fit_packing"](spark, SMALL).collect()
    least = math.ceil(sum(r["length"] for r in found) / 4096)
    assert check_pieces(found, docs) <= least * 1.02 + 1


def test_packing_of_odd_rows(odd):
    check_pieces(pack_documents(odd, queries.WORD_BPE).collect(), [(r[0], r[1]) for r in ODD])
    check_pieces(pack_documents(odd, queries.WORD_BPE, capacity=16).collect(), [(r[0], r[1]) for r in ODD], 16)


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_each_item_once(seed):
    dice = random.Random(seed)
    capacity = dice.choice([16, 100, 512])
    histogram = {n: dice.randrange(1, 200) for n in dice.sample(range(1, capacity + 1), 15)}
    held = collections.Counter()
    for run in pack(histogram, capacity):
        assert sum(run.items) <= capacity
        for item in run.items:
            held[item] += run.copies
    assert held == collections.Counter(histogram)


def cut_bins(seed, kinds, most):
    """Lengths of full bins that were cut at random: the optimum is their number."""
    dice, histogram, bins = random.Random(seed), collections.Counter(), 0
    for _ in range(kinds):
        cuts = sorted(dice.sample(range(1, 4096), dice.randrange(1, 5)))
        n = dice.randrange(1, most)
        bins += n
        for a, b in zip([0, *cuts], [*cuts, 4096]):
            histogram[b - a] += n
    return histogram, bins


def in_bins(runs):
    return sum(r.copies for r in runs)


@pytest.mark.parametrize("histogram, optimum, alone", [
    ({2064: 600, 1040: 600, 1056: 600, 992: 1200}, 900, 1100),
    ({1366: 300, 1365: 600}, 300, 350),
    ({2049: 50, 1366: 50, 681: 50}, 50, 50),
    ({1300: 200, 1398: 400}, 200, 200),
])
def test_program_finds_the_optimum(histogram, optimum, alone):
    assert in_bins(programmed(histogram, 4096)) == in_bins(pack(histogram, 4096)) == optimum
    assert in_bins(best_fit([], dict(histogram), 4096)) == alone


@pytest.mark.parametrize("seed, kinds, most", [(1, 3, 400), (2, 8, 300), (3, 25, 200), (4, 80, 100)])
def test_packing_is_near_the_optimum(seed, kinds, most):
    histogram, optimum = cut_bins(seed, kinds, most)
    found, alone = in_bins(pack(histogram, 4096)), in_bins(best_fit([], dict(histogram), 4096))
    assert optimum <= found <= min(alone, 1.02 * optimum)


def test_knapsack_against_all_choices():
    dice = random.Random(5)
    for _ in range(40):
        sizes, most = [dice.randrange(1, 9) for _ in range(4)], [dice.randrange(0, 4) for _ in range(4)]
        values, room = [dice.random() for _ in range(4)], dice.randrange(4, 20)
        choices = [[]]
        for n in most:
            choices = [[*c, k] for c in choices for k in range(n + 1)]
        fits = [c for c in choices if sum(k * s for k, s in zip(c, sizes)) <= room]
        best = max(sum(k * v for k, v in zip(c, values)) for c in fits)
        import numpy as np

        found = knapsack(sizes, np.array(values), most, room)
        assert found in fits and abs(sum(k * v for k, v in zip(found, values)) - best) < 1e-9


def test_program_covers_all_classes():
    sizes, counts = [30, 40, 60, 70], [100, 50, 100, 50]
    found = fractional(sizes, counts, 100)
    covered = [sum(c[k] * x for c, x in found.items()) / counts[k] for k in range(4)]
    assert min(covered) > 0.8 and sum(found.values()) < 1.2 * 150
    assert all(sum(n * s for n, s in zip(c, sizes)) <= 100 for c in found)


def test_path_is_a_parameter():
    assert queries.WORD_BPE == public_tokenizers.path("word_bpe_49k.json")
