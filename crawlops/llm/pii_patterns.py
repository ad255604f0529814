"""Personal data of fixed form: e-mail addresses, IP addresses, card and phone numbers."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")

# The forms of personal data that the base finds.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # no match begins inside a number
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; looked up from each @ so that long words cost no more than their length."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end), kinds as in ``KINDS``, ordered by kind and start."""
    spans = [(0, s, e) for s, e in emails(text)]
    if DIGITS.search(text) is None:
        return spans
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(byte_part, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:  # 19 digits and 18 marks at most
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return spans
