"""Maximum-scoring segments of a sequence."""

from __future__ import annotations

import numpy as np


def maximal(scores: np.ndarray) -> list[tuple[int, int, float, float]]:
    """All maximal segments: first place, place behind the last, sums of the scores before and with it.

    These are the stretches of the largest positive sums, as Ruzzo and Tompa define them.  Each candidate
    knows the nearest earlier one that begins lower; a new positive score goes back along these
    steps only, and no step is gone twice, so the time is linear whatever the drift of the sums.
    """
    ends = np.cumsum(np.asarray(scores, dtype=float))
    found: list[tuple[int, int, float, float, int]] = []  # the last: nearest earlier candidate that begins lower
    rising = np.flatnonzero(np.asarray(scores) > 0)
    befores = np.where(rising > 0, ends[rising - 1], 0.0)
    for at, low, high in zip(rising.tolist(), befores.tolist(), ends[rising].tolist()):
        first, back = at, len(found) - 1
        while True:
            while back >= 0 and found[back][2] >= low:
                back = found[back][4]
            if back < 0 or found[back][3] >= high:
                break
            first, _, low, _, before = found[back]
            del found[back:]
            back = before
        found.append((first, at + 1, low, high, back))
    return [f[:4] for f in found]
