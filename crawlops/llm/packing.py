"""Packing of tokenized documents into training sequences of fixed capacity."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlops.llm.config_lp import Run, pack
from crawlops.llm.texts import CACHED_LENGTH, held, map_texts
from crawlops.llm.vocab import SPACE
from crawlops.session import cut

CAPACITY = 4096
END_ID = 1
CACHED = 400_000  # words whose ids a worker keeps
WORD_END = "</w>"  # of the last token of a word
PLAIN = "\u0250"  # below it no character combines with another


def char_class(kind: str) -> str:
    """Characters below PLAIN of a Unicode category, for the standard regular expressions, which are twice as fast."""
    return "".join(re.escape(c) for c in map(chr, range(ord(PLAIN))) if regex.match(rf"\p{{{kind}}}", c))


LETTERS, DIGITS = char_class("L"), char_class("N")
PLAIN_WORDS = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^{SPACE}{LETTERS}{DIGITS}]+")
NOT_PLAIN = re.compile(f"[{PLAIN}-\U0010ffff]|<\\|")  # other letters, or what may be a special string


class TextIds:
    """Ids of a text as the library gives them; no token spans a space or two words.

    The words of a text that are not known yet go to the library in one call, and the ids are cut where words end.
    """

    def __init__(self, path: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, dtype=bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.words: dict[str, bytes] = {}
        self.cached = cached

    def asked(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        found = self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)  # no places of tokens are asked for
        ids = np.array(found[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or len(ids) and cuts[-1] != len(ids):
            return {w: self.asked(w) for w in words}
        whole = ids.tobytes()
        return {w: whole[4 * a : 4 * b] for w, a, b in zip(words, [0, *cuts.tolist()], cuts.tolist())}

    def __call__(self, text: str) -> bytes:
        if not text.isascii() and NOT_PLAIN.search(text) or "<|" in text:
            parts = text.split(" ")
            return b"".join([self.asked(p) if NOT_PLAIN.search(p) else self.plain(p) for p in parts])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        words, known = PLAIN_WORDS.findall(text.lower()), self.words
        unknown = set(words).difference(known)
        if not unknown:
            return b"".join([known[w] for w in words])
        found = self.encoded(list(unknown))
        if len(known) < self.cached:  # the first words stay, up to a limit
            known.update((w, ids) for w, ids in found.items() if len(w) <= CACHED_LENGTH)
        return b"".join([found[w] if w in found else known[w] for w in words])


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens with their lengths and checksums, numbered by task and length.

    ``part`` is the task that made the row and ``nth`` counts the earlier rows of that task
    with the same length.  Both are stored with the row, so they don't change when it is read again.
    """

    def make():
        ids_of, seen, part = held(("packing", path, cached), lambda: TextIds(path, cached)), Counter(), TaskContext.get().partitionId()

        def find(text):
            ids = ids_of(text) + struct.pack("<I", END_ID)
            rows = []
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                rows.append((piece, at // 4, len(own) // 4, zlib.crc32(own), part, seen[len(own)]))
                seen[len(own)] += 1
            return rows

        return find

    schema = "piece int, start long, length long, ids_crc32 long, part int, nth long"
    return map_texts(docs, make, schema, many=True, id_col=id_col, text_col=text_col)


def places(runs: list[Run], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots by (length, first rank): keys, first sequence and offset of each."""
    upto, found, sequence = Counter(), [], 0
    for run in runs:
        offset = 0
        for length in run.items:
            found.append((length, upto[length], sequence, offset))
            upto[length] += run.copies
            offset += length
        sequence += run.copies
    table = np.array(sorted(found), dtype=np.int64).reshape(-1, 4)
    return table[:, :2].copy(), table[:, 2].copy(), table[:, 3].copy()


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    ``path``: a JSON vocabulary without tokens across spaces that every executor can open;
    ``cached``: words that a worker keeps, for speed against memory.  The driver sees one row per length, at most ``capacity`` of them, and plans runs of
    equal sequences.  Pieces get their rank among those of equal length from the counts
    per task and length, so a crowded length meets in no task.

    A null or empty text is the end id alone; repeated rows and null ids are packed like
    any other; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, path, capacity, id_col, text_col, cached))
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    plan = spark.sparkContext.broadcast(places(pack(histogram, capacity), capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("first"))
    ranked = pieces.join(starts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")
    )

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = plan.value
        lengths, at = np.unique(keys[:, 0], return_index=True)
        ends = np.append(at[1:], len(keys))
        step = int(keys[:, 1].max()) + 1 if len(keys) else 1
        order = np.searchsorted(lengths, keys[:, 0]) * step + keys[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            kind = np.searchsorted(lengths, length)
            slot = np.minimum(np.searchsorted(order, kind * step + np.minimum(rank, step - 1), side="right"), ends[kind]) - 1
            sequence = sequences[slot] + rank - keys[slot, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offsets[slot])], names=names
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
