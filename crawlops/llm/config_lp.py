"""Bin packing of a length histogram by its configuration linear program.

A configuration is a set of lengths that fit into one bin together; the program asks
for the fewest configurations that hold all items.  Multiplicative weights solve it:
each round prices the lengths by how much of them is still uncovered, a knapsack
dynamic program finds the best configuration at these prices, and the prices of what it
covers fall.  The fractional solution is rounded down, and what is left goes best-fit
into the smallest sufficient room.

All work is on runs of equal lengths, so it depends on the capacity and not on the
number of items.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

CLASSES = 200  # length classes of the program; an item counts as the longest of its class
WORK = 50_000  # classes priced in all rounds of one solution
ROUNDS = 600  # of one solution, at most
STEP = 0.25
PASSES = 4  # solutions, each one of what the whole bins of those before have left


@dataclass
class Run:
    """``copies`` equal bins with these items."""

    items: list[int]
    copies: int


def knapsack(sizes: list[int], values: np.ndarray, most: list[int], capacity: int) -> list[int]:
    """How often to take each size, at most ``most`` times, for the greatest value within the capacity.

    Copies of a size are tried in bundles of 1, 2, 4 and so on, which give every number of them.
    """
    best, steps = np.zeros(capacity + 1), []
    for k, size in enumerate(sizes):
        bundle, rest = 1, most[k]
        while rest:
            n = min(bundle, rest)
            more = best[: -n * size] + n * values[k]
            better = more > best[n * size :]
            if better.any():
                np.maximum(best[n * size :], more, out=best[n * size :])
                steps.append((k, n, better))
            bundle, rest = 2 * bundle, rest - n
    taken, room = [0] * len(sizes), capacity
    for k, n, better in reversed(steps):
        if room >= n * sizes[k] and better[room - n * sizes[k]]:
            taken[k] += n
            room -= n * sizes[k]
    return taken


def fractional(sizes: list[int], counts: list[int], capacity: int) -> dict[tuple[int, ...], float]:
    """Configurations with numbers of bins, parts of bins too, that hold no more than there is of any class.

    The class that is covered best is covered once; the prices see to it that the others are nearly so.
    """
    demand = np.array(counts, dtype=float)
    log_weight = np.log(demand * np.array(sizes))
    most = [min(n, capacity // s) for s, n in zip(sizes, counts)]
    solution: dict[tuple[int, ...], float] = defaultdict(float)
    covered = np.zeros(len(sizes))
    for _ in range(min(ROUNDS, WORK // len(sizes) + 1)):
        prices = np.exp(log_weight - log_weight.max()) / demand
        taken = knapsack(sizes, prices, most, capacity)
        share = np.array(taken) / demand
        step = STEP / share.max()
        solution[tuple(taken)] += step
        covered += step * share
        log_weight -= step * share
    return {c: x / covered.max() for c, x in solution.items()}


def classes(histogram: dict[int, int], wanted: int = CLASSES) -> list[list[int]]:
    """Every length for itself if there are few, else neighbours, cut into classes of about equal total length."""
    lengths = sorted(n for n, c in histogram.items() if c)
    if len(lengths) <= wanted:
        return [[n] for n in lengths]
    weight = np.cumsum([n * histogram[n] for n in lengths])
    found = defaultdict(list)
    for length, upto in zip(lengths, weight):
        found[int((upto - 1) * wanted // weight[-1])].append(length)
    return list(found.values())


class Stock:
    """Items that are left, by length; ``left`` is kept up to date."""

    def __init__(self, left: dict[int, int]):
        self.left, self.lengths = left, sorted(n for n, c in left.items() if c)

    def take(self, most: int, least: int, n: int) -> tuple[int, int]:
        """The longest length between the limits that is left, and up to ``n`` items of it; (0, 0) if there is none."""
        at = bisect.bisect_right(self.lengths, most) - 1
        if at < 0 or self.lengths[at] < least:
            return 0, 0
        length = self.lengths[at]
        n = min(n, self.left[length])
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.pop(at)
        return length, n


def filled(limits: list[tuple[int, int]], copies: int, stock: Stock, capacity: int) -> list[Run]:
    """``copies`` bins, each with an item between each of the limits, fewer if they run out, and then with the longest that fit."""
    made, open_ = [], [Run([], copies)]
    while open_:
        run = open_.pop()
        room, place = capacity - sum(run.items), len(run.items)
        most, least = limits[place] if place < len(limits) else (room, 1)
        length, n = stock.take(min(room, most), least, run.copies)
        if not n and place < len(limits):
            length, n = stock.take(room, 1, run.copies)
        if not n:
            made.append(run)
            continue
        if n < run.copies:
            open_.append(Run(run.items, run.copies - n))
        open_.append(Run([*run.items, length], n))
    return [r for r in made if r.items]


def rounded(left: dict[int, int], capacity: int) -> list[Run]:
    """Whole copies of the configurations of one solution, filled with items; they leave ``left``.

    The shortest item of a configuration may be any that fills the rest of the bin best, as the others may
    be shorter than their classes are counted.
    """
    groups, stock, runs = classes(left), Stock(left), []
    sizes, counts = [g[-1] for g in groups], [sum(left[n] for n in g) for g in groups]
    for taken, wish in sorted(fractional(sizes, counts, capacity).items(), key=lambda c: (-c[1], c[0])):
        limits = [(groups[k][-1], groups[k][0]) for k in reversed(range(len(groups))) for _ in range(taken[k])]
        copies = int(wish + 1e-9)
        if copies:
            runs += filled(limits[:-1], copies, stock, capacity)
    return runs


def programmed(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Bins by the program: its whole solution rounded down, what is left solved again, the last items best-fit."""
    left, runs = {n: c for n, c in histogram.items() if c}, []
    for _ in range(PASSES):
        made = rounded(left, capacity) if left else []
        runs += made
        left = {n: c for n, c in left.items() if c}
        if not made:
            break
    return best_fit(runs, left, capacity)


def best_fit(runs: list[Run], left: dict[int, int], capacity: int) -> list[Run]:
    """Put the items that are left, longest first, where the least room remains."""
    by_room: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        by_room[capacity - sum(run.items)].append(run)
    rooms = sorted(by_room)

    def put(room: int, run: Run) -> None:
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append(run)

    for length in sorted((n for n, c in left.items() if c), reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, Run([length] * each, n // each))
                if n % each:
                    put(capacity - n % each * length, Run([length] * (n % each), 1))
                break
            room = rooms[at]
            run = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            times = min(room // length, max(1, n // run.copies))
            copies = min(run.copies, n // times)
            if copies < run.copies:
                put(room, Run(run.items, run.copies - copies))
            put(room - times * length, Run(run.items + [length] * times, copies))
            n -= times * copies
    return [run for room in rooms for run in by_room[room]]


def pack(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Bins that hold every item of the histogram (length -> number of items) once.

    The program packs all of them; should best-fit alone need fewer bins, its plan is taken.
    """
    program, plain = programmed(histogram, capacity), best_fit([], dict(histogram), capacity)
    return min(program, plain, key=lambda runs: sum(r.copies for r in runs))
