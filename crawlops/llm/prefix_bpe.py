"""Byte-pair encoding by dynamic programming over prefixes, and its decoding.

Every prefix of a word has one last token in its byte-pair encoding.  An automaton over
the vocabulary finds all tokens that end at a place; the one that fits the last token
of the prefix before it is stored, and the ids follow from the back-pointers.  Two
tokens fit if merging would never join across their border.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import unicodedata

import ahocorasick
import regex
from pyspark.sql import DataFrame

from crawlops.llm.texts import Cache, held, map_texts
from crawlops.llm.vocab import SPACE, Vocab, byte_symbols, load, symbols

# The pattern by which the word tokenizer picks words, and its mark of a word's end.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
END = "</w>"
LAST = 0x10000  # added to the code of a word's last symbol


def closed(token: str) -> str:
    """A token with its end mark folded into the last symbol."""
    if not token.endswith(END) or token == END:
        return token
    body = token[: -len(END)]
    return body[:-1] + chr(ord(body[-1]) + LAST)


class PrefixCoder:
    """Exact ids of whole texts, and the text that the ids decode to."""

    def __init__(self, vocab: Vocab):
        self.vocab = vocab
        self.names = {i: t for t, i in vocab.ids.items()} | {i: t for t, i in vocab.special.items()}
        base = [t for s in byte_symbols() for t in (s, s + END)]
        made = [a + b for a, b in vocab.merges]
        order = {t: i for i, t in enumerate(base + made)}  # tokens by the time they can first appear
        self.ids = [vocab.ids[t] for t in order]
        self.pairs = {(order[a], order[b]): order[a + b] for a, b in vocab.merges}
        self.halves = [(i, i) for i in range(len(base))] + [(order[a], order[b]) for a, b in vocab.merges]
        self.fits = functools.lru_cache(maxsize=1 << 18)(self.compatible)
        whole = [True] * len(base)  # merging a token's own symbols gives the token
        for token, (a, b) in enumerate(self.halves[len(base) :], len(base)):
            whole.append(whole[a] and whole[b] and self.compatible(a, b, token))
        self.matches = ahocorasick.Automaton()
        for name, token in order.items():
            if whole[token]:
                key = closed(name)
                self.matches.add_word(key, (token, len(key)))
        self.matches.make_automaton()
        self.words = Cache(self.encode_word, 500_000)
        self.chunks = Cache(self.encode_chunk, 500_000)

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging keeps the border between two tokens, looking at merges before ``below``.

        The later of the two is taken apart, down to single symbols; a merge across
        the border that comes before the part taken last was made would have won.
        """
        below = len(self.ids) if below is None else below
        while True:
            if self.pairs.get((left, right), below) < below:
                return False
            a, b = self.halves[left][1], self.halves[right][0]
            if left > right and a != left or b == right:
                if a == left:
                    return True
                below, left = left, a
            else:
                below, right = right + 1, b

    def encode_word(self, word: str) -> tuple[bytes, str]:
        row = symbols(word)
        row = row[:-1] + chr(ord(row[-1]) + LAST)
        size, fits = len(row), self.fits
        last, start = [-1] * size, [0] * size  # of the prefix that ends at each symbol
        for end, (token, length) in self.matches.iter(row):
            if last[end] < 0:
                before = end - length
                if before < 0 or (last[before] >= 0 and fits(last[before], token)):
                    last[end], start[end] = token, before
        found, at = [], size - 1
        while at >= 0:
            found.append(self.ids[last[at]])
            at = start[at]
        found.reverse()
        return struct.pack(f"<{len(found)}I", *found), " ".join([self.names[i] for i in found])

    def plain(self, text: str) -> list[tuple[bytes, str]]:
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each sigma by itself
        return [self.words[w] for w in WORDS.findall(low)]

    def encode_chunk(self, chunk: str) -> tuple[bytes, str]:
        found = []
        for place, part in enumerate(self.vocab.parts(chunk)):
            found += [(struct.pack("<I", self.vocab.special[part]), part)] if place % 2 else self.plain(part)
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and what they decode to; no token spans a space, so text is cut there."""
        found = list(map(self.chunks.__getitem__, text.split(" ")))
        return b"".join([ids for ids, _ in found]), " ".join([part for _, part in found if part])

    def encode(self, text: str) -> bytes:
        return self.both(text)[0]

    def decode(self, ids: bytes) -> str:
        """The text of any ids: token names with spaces between."""
        return " ".join([self.names[i] for (i,) in struct.iter_unpack("<I", ids)])


def coder(path: str) -> PrefixCoder:
    return held(("prefix coder", path), lambda: PrefixCoder(load(path)))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text.

    ``path``: a JSON vocabulary with word ends that every executor can open.  A null or
    empty text has no ids; repeated rows and null ids stay; an empty table gives no rows;
    other columns are not read.
    """

    def make():
        code = coder(path)

        def find(text):
            ids, decoded = code.both(text)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return find

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col=id_col, text_col=text_col)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` with the ids as an array."""

    def make():
        code = coder(path)
        return lambda text: ([i for (i,) in struct.iter_unpack("<I", code.encode(text))],)

    return map_texts(docs, make, "ids array<int>", id_col=id_col, text_col=text_col)
