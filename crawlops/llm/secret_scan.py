"""Secrets in whole texts: fixed forms, and random strings by their token efficiency.

A tokenizer's vocabulary holds what is common in text, so common strings take few tokens
for their length.  A random string has a low ratio of characters to tokens; known forms of
digests and identifiers have it too and are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from crawlops.llm.segments import maximal
from crawlops.llm.texts import held, map_texts, small_batches

# The forms of secrets that the base finds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST = 8
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")  # holds every access and hex span of the base, and every candidate
MAX_RATIO = 2.0  # characters per token; words have more in small letters and mostly in capitals too, random letters less
LEAST, LEAST_LETTERS = 16, 10  # characters of a found stretch of parts, and those of its parts that are no plain numbers
SHORT = 0.25  # characters that a part below LEAST must have less: few tokens tell little

# How many hexadecimal digits the usual digests have.
DIGESTS = (32, 40, 48, 56, 64, 96, 128)
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NAME = re.compile(r"([A-Z]?[a-z]*|[A-Z]+|[0-9]+)([-_+/=]+([A-Z]?[a-z]*|[A-Z]+|[0-9]+))*")  # judged by its parts
CAMEL = re.compile(r"[A-Za-z]?[a-z]+([A-Z][a-z]{2,})+[0-9]{0,4}|[A-Za-z][a-z]{2,}[0-9]{1,4}")  # the same
PART = re.compile(rf"(?<![0-9A-Za-z]){UUID.pattern}(?![0-9A-Za-z])|[0-9A-Za-z]+")


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("secret-scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def known_form(run: str) -> bool:
    """Digests and identifiers."""
    return bool(ALL_HEX.fullmatch(run) and len(run) in DIGESTS or UUID.fullmatch(run))


def random_parts(run: str, tokens: Callable[[str], list[int]], max_ratio: float) -> list[tuple[int, int]]:
    """Stretches (start, end) of parts between marks that take more tokens than words do.

    Each part counts alone, so words beside a random part don't hide it.  Known forms end a
    stretch; plain numbers neither help nor end it.
    """
    parts = [(m.start(), m.end(), m[0]) for m in PART.finditer(run)]
    scores = []
    for _, _, part in parts:
        if known_form(part):
            scores.append(-1e9)
        elif part.isdigit():
            scores.append(0.0)
        else:
            scores.append(max_ratio * len(tokens(part)) - len(part) + (1e-6 if len(part) >= LEAST else -SHORT))
    found = []
    for first, behind, _, _ in maximal(scores) if parts else ():
        inside = [part for _, _, part in parts[first:behind]]
        if parts[behind - 1][1] - parts[first][0] >= LEAST and sum(len(p) for p in inside if not p.isdigit()) >= LEAST_LETTERS:
            found.append((parts[first][0], parts[behind - 1][1]))
    return found


def scanner(path: str, pattern: str, max_ratio: float = MAX_RATIO) -> Callable[[str], list[tuple[int, int, int]]]:
    """Function from a text to its spans (start, kind, end), ordered; kinds as in ``KINDS``."""
    tokens = held(("secret scan", path, pattern), lambda: encoding(path, pattern)).encode_ordinary

    def find(text: str) -> list[tuple[int, int, int]]:
        spans, low = [], text.lower()
        if any(name in low for name in ASSIGN_NAMES):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        runs = [(m.start(), m[0]) for m in RUN.finditer(text)]
        for at, run in runs:
            if "AKIA" in run:
                spans += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(run) if len(m[0]) >= ACCESS_LEAST]
            spans += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run)]
        base = sorted(spans)
        for at, run in runs:
            end = at + len(run)
            if known_form(run) or any(s <= at and end <= e for s, _, e in base):
                continue
            if not (NAME.fullmatch(run) or CAMEL.fullmatch(run)) and len(run) <= max_ratio * len(tokens(run)):
                spans.append((at, 3, end))
                continue
            for start, behind in random_parts(run, tokens, max_ratio):
                if not any(s <= at + start and at + behind <= e for s, _, e in base):
                    spans.append((at + start, 3, at + behind))
        return sorted(spans)

    return find


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every whole text.

    ``path``: a vocabulary of ranks that every executor can open, ``pattern``: the one that cuts
    text for it.  Spans are kind:start:end in code points.  A null or empty text has none;
    repeated rows and null ids stay; an empty table gives no rows; other columns are not read.
    """

    def make():
        scan = scanner(path, pattern)

        def find(text):
            spans = scan(text)
            base = [s for s in spans if s[1] < 3]
            counts = [sum(s[1] == kind for s in base) for kind in range(3)]
            return *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)

        return find

    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_texts(docs, make, schema, id_col=id_col, text_col=text_col)


def blank(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each group of overlapping spans replaced by the mark."""
    out, upto = [], 0
    for start, _, end in spans:
        if start >= upto:
            out += [text[upto:start], mark]
        upto = max(upto, end)
    return "".join(out) + text[upto:]


def redacted(text: Column | str, path: str, pattern: str, mark: str = "[secret]") -> Column:
    """The text without its secrets; null stays null."""

    small_batches(SparkSession.active())

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        scan = scanner(path, pattern)
        found = [t if t is None else blank(t, scan(t), mark) for t in texts.to_pylist()]
        return pa.array(found, pa.string())

    return clean(F.col(text) if isinstance(text, str) else text)
