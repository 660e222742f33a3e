"""Stateful processors for ordered rows of keys; their state lives in the engine's store.

Keys are dealt into ``BUCKETS`` by hash. A processor gets the rows that a bucket has in one micro-batch, works on them as
whole columns, and keeps one small state per key in a map of the store, of which it reads and writes the entries of keys with rows.
So the time goes with rows and keys' states, not with one call of Python per key. Rows are put in order within
the batch; across batches they must arrive in order, as the log they come from has them. What a task holds is bounded by
the size of a micro-batch (``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` of the source), whatever share a key has.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilgrid.functions import values as V


#: Buckets of keys; a checkpoint is bound to their number.
BUCKETS = 1024

#: Names in the store's frames, which rename others: the rows' own columns, the key as text, what rows are ordered by, what is read.
OWN, BUCKET, KEY, ORDER, READ = "own{}", "bucket", "key", "order{}", "read{}"


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    """``rows`` with strings as Python objects, which Arrow turns into one array each."""
    return rows.assign(**{c: rows[c].astype(object).where(rows[c].notna(), None) for c in rows.columns if isinstance(rows[c].dtype, pd.StringDtype)})


def _wake(handle: StatefulProcessorHandle, due: int) -> None:
    """The bucket's one timer goes off at ``due`` milliseconds, or earlier if it was to."""
    timers = list(handle.listTimers())
    if not timers or due < min(timers):
        for timer in timers:
            handle.deleteTimer(timer)
        handle.registerTimer(due)


class Ordered(StatefulProcessor):
    """Rows of each key in the order of ``ORDER`` columns; ``follow`` gives the keys' new states and columns for the rows.

    ``reads`` names the copies of columns that ``follow`` looks at; these and the key do not go on. ``forget`` milliseconds after its last write the engine drops a state (processing time); None keeps it.
    """

    schema: str
    added: tuple[str, ...]

    def __init__(self, n_order: int, reads: tuple[str, ...] = (), forget: int | None = None):
        self.order, self.forget = [ORDER.format(i) for i in range(n_order)], forget
        self.reads = {c: READ.format(i) for i, c in enumerate(reads)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", "key string", self.schema, self.forget)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        codes, names = pd.factorize(batch[KEY])
        batch = batch.assign(**{KEY: codes}).sort_values([KEY, *self.order], na_position="first", ignore_index=True)
        first = np.searchsorted(batch[KEY].to_numpy(), np.arange(len(names) + 1))
        known = self.state.exists()
        before = [self.state.getValue((name,)) if known else None for name in names]
        after, columns = self.follow(before, batch, first)
        for name, old, new in zip(names, before, after, strict=True):
            if self.forget is not None or old is None or tuple(old) != new:
                self.state.updateValue((name,), new)
        self.remember(after)
        kept = batch.drop(columns=[BUCKET, KEY, *self.order, *self.reads.values()])
        yield _plain(kept.assign(**dict(zip(self.added, columns, strict=True))))

    def follow(self, states: list[tuple | None], rows: pd.DataFrame, first: np.ndarray) -> tuple[list[tuple], tuple]:
        """The rows of key ``i`` are ``first[i]`` to ``first[i + 1]``."""
        raise NotImplementedError

    def remember(self, states: list[tuple]) -> None:
        """Called after the states are written."""

    def close(self) -> None:
        pass


class RateLimit(Ordered):
    """Requests of a window that opens with its first request; more than ``limit`` are rejected.

    With ``expires`` an event-time timer drops the state once the watermark has passed the window: a later request opens
    a new one anyway.
    """

    schema, added = "window_start bigint, request_no bigint", ("window_start", "request_no", "allowed")

    def __init__(self, n_order: int, limit: int, window: int, expires: bool):
        super().__init__(n_order)
        self.limit, self.window, self.expires = limit, window, expires

    def follow(self, states: list[tuple | None], rows: pd.DataFrame, first: np.ndarray) -> tuple[list[tuple], tuple]:
        times = rows[self.order[0]].to_numpy(np.int64)
        start, number = np.empty(len(times), np.int64), np.empty(len(times), np.int64)
        after = []
        for state, i, stop in zip(states, first[:-1].tolist(), first[1:].tolist(), strict=True):
            opened, count = state if state is not None else (int(times[i]), 0)
            while i < stop:
                if times[i] - opened > self.window:
                    opened, count = int(times[i]), 0
                end = max(i + 1, i + int(np.searchsorted(times[i:stop], opened + self.window, side="right")))
                start[i:end], number[i:end] = opened, np.arange(count + 1, count + 1 + end - i)
                count, i = count + end - i, end
            after.append((opened, count))
        return after, (start, number, number <= self.limit)

    def _due(self, state: tuple) -> int:
        return (state[0] + self.window) // 1000 + 1

    def remember(self, states: list[tuple]) -> None:
        if self.expires:
            _wake(self.handle, min(map(self._due, states)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark, rest = timerValues.getCurrentWatermarkInMs(), []
        for name, state in list(self.state.iterator()):
            if (due := self._due(state)) <= watermark:
                self.state.removeKey(name)
            else:
                rest.append(due)
        if rest:
            self.handle.registerTimer(min(rest))
        yield pd.DataFrame()


class Steps(Ordered):
    """A step is accepted when it follows the last accepted one."""

    schema, added = "last int", ("accepted", "expected_step", "continuity_break")

    def __init__(self, n_order: int, step: str, forget: int | None):
        super().__init__(n_order, (step,), forget)
        self.step = self.reads[step]

    def follow(self, states: list[tuple | None], rows: pd.DataFrame, first: np.ndarray) -> tuple[list[tuple], tuple]:
        steps, before, after = rows[self.step].to_numpy(), [], []
        asked = steps.tolist()
        for state, start, stop in zip(states, first[:-1].tolist(), first[1:].tolist(), strict=True):
            last = state[0] if state else 0
            for step in asked[start:stop]:
                before.append(last)
                if step == last + 1:
                    last = step
            after.append((int(last),))
        expected = np.array(before, np.int32) + 1
        return after, (steps == expected, expected, (expected == 1) & (steps > 1))


class Frames(Ordered):
    """A frame is skipped when its content hash is that of the frame before it and not blank."""

    schema, added = "content string", ("skipped",)

    def __init__(self, n_order: int, content: str, forget: int | None):
        super().__init__(n_order, (content,), forget)
        self.content = self.reads[content]

    def follow(self, states: list[tuple | None], rows: pd.DataFrame, first: np.ndarray) -> tuple[list[tuple], tuple]:
        now = rows[self.content].astype(object).where(rows[self.content].notna(), None).tolist()
        before = [None, *now[:-1]]
        for state, start in zip(states, first[:-1].tolist(), strict=True):
            before[start] = state[0] if state else None
        after = [(now[stop - 1],) for stop in first[1:].tolist()]
        return after, (np.array([bool(a) and a == b for a, b in zip(now, before, strict=True)], dtype=bool),)


class Lives(StatefulProcessor):
    """Lifetimes of sessions' vaults: accesses at most ``ttl`` microseconds apart; times are whole microseconds.

    Lives that later accesses may still lengthen or join are the state of a session. A timer of the bucket closes lives once the watermark has
    passed their last access by more than the TTL. An access behind the watermark comes out as a row of its own, late: its
    life may have been written already. So each access is in one life, open or written, or one late row.
    """

    def __init__(self, time: str, ttl: int):
        self.time, self.ttl = time, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("lives", "key string", "lives array<struct<opened:bigint,last_access:bigint,n_accesses:bigint>>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        found: dict[str, list[tuple]] = {}
        for batch in rows:  # one part of the bucket's rows at a time
            times = batch[self.time].to_numpy(np.int64)
            late = times < watermark
            if late.any():
                yield self._rows(batch[KEY][late].to_numpy(object), times[late], times[late], 1, "late")
            self._gather(batch[KEY][~late], times[~late], found)
        known, due = self.open.exists(), []
        for name, parts in found.items():
            lives = self._merged([*(self._of(self.open.getValue((name,))) if known else ()), *parts])
            self.open.updateValue((name,), (lives,))
            due.append(self._due(lives[0]))
        if due:
            _wake(self.handle, min(due))
        yield self._rows(*np.zeros((4, 0), np.int64), "closed")

    def _gather(self, names: pd.Series, times: np.ndarray, found: dict[str, list[tuple]]) -> None:
        """Adds the lives that these accesses make by themselves."""
        if not len(times):
            return
        codes, names = pd.factorize(names)
        order = np.lexsort((times, codes))
        codes, times = codes[order], times[order]
        starts = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (times[1:] - times[:-1] > self.ttl))))
        ends = np.append(starts[1:], len(times))
        for code, opened, last, n in zip(codes[starts].tolist(), times[starts].tolist(), times[ends - 1].tolist(), (ends - starts).tolist(), strict=True):
            found.setdefault(names[code], []).append((opened, last, n))

    @staticmethod
    def _of(state: tuple | None) -> list[tuple]:
        return [tuple(life) for life in state[0]] if state else []

    def _merged(self, lives: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for opened, last, n in sorted(lives):
            if out and opened - out[-1][1] <= self.ttl:
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
            else:
                out.append((opened, last, n))
        return out

    def _due(self, life: tuple) -> int:
        return (life[1] + self.ttl) // 1000 + 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        closed, due = [], []
        for name, state in list(self.open.iterator()):
            lives = self._of(state)
            rest = [x for x in lives if x[1] + self.ttl >= watermark]
            closed += [(name[0], *x) for x in lives if x[1] + self.ttl < watermark]
            if not rest:
                self.open.removeKey(name)
            elif len(rest) < len(lives):
                self.open.updateValue(name, (rest,))
            due += [self._due(x) for x in rest[:1]]
        if due:
            self.handle.registerTimer(min(due))
        names, *spans = zip(*closed, strict=True) if closed else ((), (), (), ())
        yield self._rows(names, *(np.array(x, np.int64) for x in spans), "closed")

    @staticmethod
    def _rows(names: Any, opened: np.ndarray, last: np.ndarray, n: Any, outcome: str) -> pd.DataFrame:
        return _plain(pd.DataFrame({KEY: pd.Series(list(names), dtype=object), "opened": opened, "last_access": last, "n_accesses": n, "outcome": outcome}))

    def close(self) -> None:
        pass


DEFAULT_WINDOW = V.RATE_WINDOW_SECONDS * 1_000_000
