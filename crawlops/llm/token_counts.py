"""Token counts by heap-driven byte-pair merging.

The symbols of a word form a linked list; a heap yields the adjacent pair of lowest
rank, again and again.  The count is the number of first symbols less the number of
merges; no identifiers are written.
"""

from __future__ import annotations

import heapq

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlops.llm.texts import Cache, held, map_texts
from crawlops.llm.vocab import SPACE, Vocab, byte_symbols, load

# Fixed value: the pattern by which the byte-level tokenizer cuts text.
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
LONG_GAP = regex.compile(rf"[{SPACE}] ")


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, vocab: Vocab):
        self.vocab = vocab
        self.first = [vocab.ids[s] for s in byte_symbols()]
        self.pairs = {(vocab.ids[a], vocab.ids[b]): (rank, vocab.ids[a + b]) for rank, (a, b) in enumerate(vocab.merges)}
        self.pieces = Cache(lambda piece: self.left_over([self.first[b] for b in piece.encode()]))
        self.after_space = Cache(lambda rest: self.cut(" " + rest))

    def left_over(self, row: list[int | None]) -> int:
        """Symbols left when no pair can be merged; ``row`` is used up."""
        pairs, size = self.pairs, len(row)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(pairs[p][0], i) for i, p in enumerate(zip(row, row[1:])) if p in pairs]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, left = heapq.heappop(heap)
            right = after[left]
            if right >= size or row[left] is None:
                continue
            found = pairs.get((row[left], row[right]))
            if found is None or found[0] != rank:
                continue  # one of the two has been merged since
            merges += 1
            row[left], row[right] = found[1], None
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
                new = pairs.get((row[left], row[after[left]]))
                if new is not None:
                    heapq.heappush(heap, (new[0], left))
            if before[left] >= 0:
                new = pairs.get((row[before[left]], row[left]))
                if new is not None:
                    heapq.heappush(heap, (new[0], before[left]))
        return size - merges

    def cut(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, PIECES.findall(text)))

    def plain(self, text: str) -> int:
        """A space that follows no other white space always begins a piece, so text is cut there first."""
        if LONG_GAP.search(text):
            return self.cut(text)
        head, *rest = text.split(" ")
        return self.cut(head) + sum(map(self.after_space.__getitem__, rest))

    def __call__(self, text: str) -> int:
        parts = self.vocab.parts(text)
        return sum(map(self.plain, parts[::2])) + len(parts) // 2


def counter(path: str) -> Counter:
    return held(("token counts", path), lambda: Counter(load(path)))


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    ``path``: a byte-level JSON vocabulary that every executor can open.  A null or empty
    text has no token; special strings inside a text count one each; repeated rows and
    null ids stay; an empty table gives no rows; other columns are not read.
    """

    def make():
        count = counter(path)
        return lambda text: (len(text.encode()), count(text))

    found = map_texts(docs, make, "n_bytes long, n_tokens long", id_col=id_col, text_col=text_col)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
