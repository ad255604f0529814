"""Per-key state machines for streams.

Every handler takes the rows of its key in order of time and number, piece by piece, so the
result does not depend on how the rows of a micro-batch arrived.  However many rows a key has in a
micro-batch, a handler holds one Arrow chunk and about two pieces of PIECE rows of them; the rest
waits, cut into ranges of time, in the state store, and leaves it again before the handler ends.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 100_000  # rows that are sorted at once
MARKS = 200  # rows between two marks from which the ranges are cut
SPILL = "range bigint, run bigint"


def spill_state(handle):
    """Where rows of a crowded key wait; empty outside a call of the handler."""
    return handle.getMapState("spill", SPILL, "data binary")


def put(spill, place: int, run: int, rows: pd.DataFrame) -> None:
    spill.updateValue((place, run), (pickle.dumps(rows, protocol=5),))


def taken(spill, place: int, run: int) -> pd.DataFrame:
    rows = pickle.loads(spill.getValue((place, run))[0])
    spill.removeKey((place, run))
    return rows


def in_order(chunks: Iterator[pd.DataFrame], spill, by: tuple[str, ...] = ("us", "event_id")) -> Iterator[pd.DataFrame]:
    """The rows of all chunks, sorted, in pieces of about PIECE rows.

    More rows than that are stored as sorted runs; marks taken from the runs cut the order into
    ranges, and each range is put together from what the runs hold of it.
    """
    by, piece = list(by), PIECE

    def sorted_rows(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts, ignore_index=True).sort_values(by, kind="stable", ignore_index=True)

    def keys(rows: pd.DataFrame) -> np.ndarray:
        return np.rec.fromarrays([rows[c].to_numpy(dtype="int64") for c in by], names=by)

    open_, size, marks = [], 0, []
    for chunk in chunks:
        open_.append(chunk)
        size += len(chunk)
        if size >= piece:
            put(spill, 0, len(marks), run := sorted_rows(open_))
            marks.append(keys(run)[::MARKS])
            open_, size = [], 0
    if not marks:
        if size:
            yield sorted_rows(open_)
        return
    if size:
        put(spill, 0, len(marks), run := sorted_rows(open_))
        marks.append(keys(run)[::MARKS])
    cuts = np.sort(np.concatenate(marks), order=by)[:: max(1, piece // MARKS)][1:]
    ranges: list[list[int]] = [[] for _ in range(len(cuts) + 1)]
    for run in range(len(marks)):
        rows = taken(spill, 0, run)
        ends = [*np.searchsorted(keys(rows), cuts), len(rows)]
        for place, (begin, end) in enumerate(zip([0, *ends], ends)):
            if end > begin:
                put(spill, place + 1, run, rows.iloc[begin:end])
                ranges[place].append(run)
    for place, runs in enumerate(ranges, 1):
        if runs:
            yield sorted_rows([taken(spill, place, run) for run in runs])


class Breaker(StatefulProcessor):
    """Failures in a row with a time limit that each failure renews; opens at a maximum, closes by time."""

    def __init__(self, max_failures: int, cooldown_us: int):
        self.max_failures, self.cooldown = max_failures, cooldown_us

    def init(self, handle) -> None:
        self.handle = handle
        self.spill = spill_state(handle)
        self.state = handle.getValueState("breaker", "fails bigint, last_fail bigint, open_until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.state.get() if self.state.exists() else (0, 0, 0)
        for batch in in_order(rows, self.spill):
            at, table = self.folded(key, at, batch)
            yield table
        self.state.update(at)
        self.handle.registerTimer(max(at[1] + self.cooldown, at[2]) // 1000 + 1)

    def folded(self, key, at: tuple[int, int, int], batch: pd.DataFrame) -> tuple[tuple[int, int, int], pd.DataFrame]:
        fails, last_fail, open_until = at
        us, failed = batch["us"].to_numpy(dtype="int64"), ~batch["success"].to_numpy(dtype=bool)
        # a run of failures ends with a success or when the last failure is too long ago
        last = np.maximum.accumulate(np.concatenate([[last_fail], np.where(failed, us, 0)]))
        ends = ~failed | ((last[:-1] > 0) & (us - last[:-1] >= self.cooldown))
        run, so_far = np.cumsum(ends), np.cumsum(failed)
        before = np.concatenate([[-fails], (so_far - failed)[ends]])
        count = so_far - before[run]
        opens = np.where(failed & (count >= self.max_failures), us + self.cooldown, 0)
        until = np.maximum.accumulate(np.concatenate([[open_until], opens]))
        shown = pd.Series(until[1:], dtype="Int64")
        table = pd.DataFrame(
            {
                "event_id": batch["event_id"].to_numpy(), "proxy_id": key[0], "failures": count, "allowed": until[:-1] <= us,
                "open_until_us": shown.mask(shown == 0),
            }
        )
        return (int(count[-1]), int(last[-1]), int(until[-1])), table

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            fails, last_fail, open_until = self.state.get()
            if max(last_fail + self.cooldown, open_until) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Sticky(StatefulProcessor):
    """One drawn index per job until the time limit counted from the draw is over."""

    def __init__(self, ttl_us: int, pool: int, seed: int):
        self.ttl, self.pool, self.seed = ttl_us, pool, seed

    def init(self, handle) -> None:
        self.handle = handle
        self.spill = spill_state(handle)
        self.state = handle.getValueState("sticky", "start bigint")

    def index(self, job, start: int) -> int:
        digest = hashlib.md5(f"{self.seed}:{job}:{start}".encode()).hexdigest()
        return int(digest[:8], 16) % self.pool

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = self.state.get()[0] if self.state.exists() else None
        for batch in in_order(rows, self.spill):
            us = batch["us"].to_numpy(dtype="int64")
            begins, at = [] if start is None else [start], 0 if start is None else int(np.searchsorted(us, start + self.ttl))
            follows = np.searchsorted(us, us + self.ttl)  # the row that begins the next block, if this one begins one
            while at < len(us):
                begins.append(int(us[at]))
                at = int(follows[at])
            block = np.maximum(np.searchsorted(begins, us, side="right") - 1, 0)  # a row from before the state keeps its block
            drawn = np.array([self.index(key[0], s) for s in begins])
            start = begins[-1]
            yield pd.DataFrame(
                {"event_id": batch["event_id"].to_numpy(), "job_id": key[0], "block_us": np.array(begins)[block], "_index": drawn[block]}
            )
        self.state.update((start,))
        self.handle.registerTimer((start + self.ttl) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and (self.state.get()[0] + self.ttl) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Heartbeat(StatefulProcessor):
    """Reports a worker once for every silence longer than the limit."""

    def __init__(self, limit_us: int):
        self.limit = limit_us

    def init(self, handle) -> None:
        self.handle = handle
        self.spill = spill_state(handle)
        self.state = handle.getValueState("beat", "last bigint, reported boolean")

    def _table(self, key, lasts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"worker": key[0], "last_us": lasts, "silent_us": lasts + self.limit})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, reported = self.state.get() if self.state.exists() else (None, False)
        for batch in in_order(rows, self.spill):
            us = batch["us"].to_numpy(dtype="int64")
            if last is None:
                last = int(us[0])
            before = np.maximum.accumulate(np.concatenate([[last], us]))  # the latest beat at each row
            silent = us - before[:-1] > self.limit
            if reported and (us >= last).any():  # only the silence that the next beat ends was reported
                silent[np.argmax(us >= last)] = False
                reported = False
            last = int(before[-1])
            if silent.any():
                yield self._table(key, before[:-1][silent])
        self.state.update((last, reported))
        self.handle.registerTimer((last + self.limit) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        last, reported = self.state.get()
        if not reported and (last + self.limit) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((last, True))
            yield self._table(key, np.array([last]))

    def close(self) -> None:
        pass


class Held(StatefulProcessor):
    """Rows while a condition stays true, with the begin of that time and whether it was long enough.

    Rows have us, cond and hold; they keep their other columns, without the keys.
    """

    def __init__(self, order: tuple[str, ...] = ("us", "event_id"), kept: tuple[str, ...] = ("event_id",)):
        self.order, self.kept = order, kept

    def init(self, handle) -> None:
        self.spill = spill_state(handle)
        self.state = handle.getValueState("held", "since bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since = self.state.get()[0] if self.state.exists() else None
        for batch in in_order(rows, self.spill, self.order):
            us, cond = batch["us"].to_numpy(dtype="int64"), batch["cond"].to_numpy(dtype=bool)
            before = np.concatenate([[since is not None], cond[:-1]])
            begins = np.where(cond & ~before, us, -1 if since is None else since)
            since_us = np.maximum.accumulate(begins)  # times ascend, so the latest begin is the largest
            since = int(since_us[-1]) if cond[-1] else None
            if cond.any():
                firing = us - since_us >= batch["hold"].to_numpy(dtype="int64") * 1_000_000
                table = batch[list(self.kept)].assign(us=us, since_us=since_us, state=np.where(firing, "firing", "pending"))
                table.insert(0, "alert", key[0])
                table.insert(1, "instance", key[1])
                yield table[cond]
        if since is None:
            self.state.clear()
        else:
            self.state.update((since,))

    def close(self) -> None:
        pass


class Steps:
    """Steps (begin, end] of one counter or gauge, from samples in order of time.

    ``prev`` is the last value, ``ends`` and the arrays beside it are the steps of the longest window and,
    as the last one, the step that is open.  A step begins with the growth since the sample before.
    """

    def __init__(self, step_us: int, longest_us: int):
        self.step, self.longest = step_us, longest_us
        self.prev: float | None = None
        self.ends = np.empty(0, dtype=np.int64)
        self.last, self.grown, self.first = np.empty(0), np.empty(0), np.empty(0)
        self.shown = 0  # steps that end later were not handed on

    def add(self, us: np.ndarray, values: np.ndarray) -> None:
        before = np.concatenate([[values[0] if self.prev is None else self.prev], values[:-1]])
        delta = np.where(values < before, values, values - before)  # after a reset the value itself
        self.prev = float(values[-1])
        ends = -(-us // self.step) * self.step
        begins = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
        grown, first, last = np.add.reduceat(delta, begins), delta[begins], values[np.append(begins[1:], len(us)) - 1]
        ends = ends[begins]
        if len(self.ends) and self.ends[-1] == ends[0]:  # goes on with the open step
            self.grown[-1] += grown[0]
            self.last[-1] = last[0]
            if np.isnan(self.first[-1]):
                self.first[-1] = first[0]
            ends, grown, first, last = ends[1:], grown[1:], first[1:], last[1:]
        self.ends, self.grown = np.concatenate([self.ends, ends]), np.concatenate([self.grown, grown])
        self.first, self.last = np.concatenate([self.first, first]), np.concatenate([self.last, last])

    def fill(self, upto: int) -> None:
        """Empty steps between those with samples and up to a time."""
        if not len(self.ends):
            return
        every = np.arange(self.ends[0], max(upto, self.ends[-1]) + 1, self.step)
        at = np.searchsorted(every, self.ends)
        columns = []
        for column, empty in ((self.grown, 0.0), (self.first, np.nan), (self.last, np.nan)):
            full = np.full(len(every), empty)
            full[at] = column
            columns.append(full)
        self.ends, (self.grown, self.first, self.last) = every, columns

    def growth(self, window_us: int) -> np.ndarray:
        """Growth in the window that ends with each step, less the first growth in it; without samples there is none."""
        total, first = np.zeros(len(self.ends)), np.full(len(self.ends), np.nan)
        place = np.arange(len(self.ends))
        for back in range(window_us // self.step, -1, -1):  # from the oldest step of the window on
            here = np.maximum(place - back, 0)
            inside = (place >= back) & (self.ends - self.ends[here] < window_us)
            total += np.where(inside, self.grown[here], 0.0)
            first = np.where(np.isnan(first) & inside, self.first[here], first)
        return total - first

    def closed(self, upto: int) -> np.ndarray:
        """Places of the steps that end by that time and were not handed on yet; marks them so."""
        found = np.flatnonzero((self.ends > self.shown) & (self.ends <= upto))
        if len(found):
            self.shown = int(self.ends[found[-1]])
        return found

    def forget(self) -> None:
        """Keep what a later window can reach."""
        if len(self.ends):
            kept = (self.ends > self.shown - self.longest) | (self.ends > self.shown)
            kept[-1] = True
            self.ends, self.grown, self.first, self.last = self.ends[kept], self.grown[kept], self.first[kept], self.last[kept]


class Measures(StatefulProcessor):
    """Measures of the rules on a series at the end of every step: last value, age, or growth in a window.

    ``rules`` gives for each metric rows (alert, kind, window, part, on every step, for all instances).
    Samples must come when their time is settled.  A step is handed on when a later sample or
    the watermark closes it; a rule on every step gets the empty ones too, by timer, so a series that falls silent is judged.
    """

    def __init__(self, step_us: int, rules: dict[str, list[tuple]], everywhere: str):
        self.step, self.rules, self.everywhere = step_us, rules, everywhere

    def init(self, handle) -> None:
        self.handle = handle
        self.spill = spill_state(handle)
        self.state = handle.getValueState("series", "data binary")

    def series(self, metric: str) -> Steps:
        steps = Steps(self.step, max(r[2] for r in self.rules[metric]) * 1_000_000 + self.step)
        if self.state.exists():
            vars(steps).update(pickle.loads(self.state.get()[0]))
        return steps

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps = self.series(key[0])
        for batch in in_order(rows, self.spill):
            steps.add(batch["us"].to_numpy(dtype="int64"), batch["value"].to_numpy(dtype=float))
            yield from self.handed(key, steps, int(steps.ends[-1]) - 1)
        self.stored(key, steps)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            steps = self.series(key[0])
            mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            yield from self.handed(key, steps, mark * 1000)
            self.stored(key, steps)

    def handed(self, key, steps: Steps, upto: int) -> Iterator[pd.DataFrame]:
        """Rows of the steps that end by that time."""
        rules = self.rules[key[0]]
        sampled = steps.ends[~np.isnan(steps.last)] if len(steps.ends) else steps.ends
        if any(r[4] for r in rules):
            steps.fill(upto // steps.step * steps.step)
        found = steps.closed(upto)
        if not len(found):
            return
        ends, last = steps.ends[found], steps.last[found]
        with_sample = np.isin(ends, sampled)
        for alert, kind, window, part, each, overall in rules:
            if window:
                grown = steps.growth(window * 1_000_000)[found]
                value = grown if kind in ("growth", "ratio") else grown / window
                value = 100 - value * 100 if kind == "busy" else value
            else:
                value = ends // 1_000_000 - last if kind == "age" else last
            shown = (with_sample | each) & ~np.isnan(value)
            if shown.any():
                yield pd.DataFrame(
                    {
                        "alert": alert, "instance": self.everywhere if overall else key[1], "part": part,
                        "ts": pd.to_datetime(ends[shown], unit="us", utc=True), "value": value[shown],
                    }
                )
        steps.forget()

    def stored(self, key, steps: Steps) -> None:
        self.state.update((pickle.dumps(vars(steps), protocol=5),))
        pending = steps.ends[steps.ends > steps.shown]
        if len(pending):
            self.handle.registerTimer(int(pending[0]) // 1000)
        elif any(r[4] for r in self.rules[key[0]]):
            self.handle.registerTimer((steps.shown + self.step) // 1000)

    def close(self) -> None:
        pass
