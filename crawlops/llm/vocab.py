"""Vocabularies of the tokenizers library's JSON files."""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass

# The Unicode property White_Space, as a character class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@dataclass(frozen=True)
class Vocab:
    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]

    @functools.cached_property
    def splitter(self) -> re.Pattern:
        """Finds the special strings; the longest one wins."""
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def parts(self, text: str) -> list[str]:
        """Plain parts at even places, special strings between them."""
        return self.splitter.split(text)


def load(path: str) -> Vocab:
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model = data["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Vocab(model["vocab"], merges, {t["content"]: t["id"] for t in data["added_tokens"]})


@functools.cache
def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def symbols(word: str) -> str:
    table = byte_symbols()
    return "".join([table[b] for b in word.encode()])
