"""The perfect binary Golay code of 23 bits: 4096 codewords, each word at most 3 bits from one."""

from __future__ import annotations

import functools
import itertools

import numpy as np

# Fixed value: the generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, DATA = 23, 12
NEAR = 6  # codewords within 4 bits of a word: one or six


@functools.cache
def syndromes() -> np.ndarray:
    """Remainder of each 23-bit word's single bits; the remainder of a word is their exclusive or."""
    out = []
    for bit in range(BITS):
        rest = 1 << bit
        for high in range(BITS - 1, BITS - DATA - 1, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - (BITS - DATA))
        out.append(rest)
    return np.array(out, dtype=np.int64)


@functools.cache
def errors() -> np.ndarray:
    """By remainder: the patterns of up to 4 bits that lead to a codeword, the smallest first; -1 where there are fewer."""
    single = syndromes()
    found: list[list[int]] = [[] for _ in range(1 << (BITS - DATA))]
    for size in range(5):
        for bits in itertools.combinations(range(BITS), size):
            rest = 0
            for bit in bits:
                rest ^= int(single[bit])
            found[rest].append(sum(1 << b for b in bits))
    return np.array([row + [-1] * (NEAR - len(row)) for row in found], dtype=np.int64)


def remainders(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.int64)
    for bit, rest in enumerate(syndromes()):
        out ^= np.where(words >> bit & 1, rest, 0)
    return out


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Indices (word x 6) of the codewords within 4 bits, the nearest first; -1 where there are fewer.

    Two words that differ in one or two bits have one in common: the codeword
    nearest to a word between them is at most 4 bits from both.
    """
    flips = errors()[remainders(words)]
    return np.where(flips < 0, -1, (words[:, None] ^ flips) >> (BITS - DATA))
