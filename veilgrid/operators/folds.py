"""State machines over ordered rows. What a bucket does to any state is a typed summary, and summaries compose.

``SUMMARY`` and ``STATE`` are the columns' types; a state of None is the start.
"""

from __future__ import annotations

import numpy as np

from veilgrid.functions import values as V


class StepSequence:
    """Accept a step only when it follows the last accepted one.

    State: the last accepted step. Rows: (step_number,). Output: accepted, expected_step,
    continuity_break (a later step while nothing has been accepted yet).

    A summary lists runs of last steps and the one that each run ends with; others stay. It has at most one run per
    different step number, whatever the number of rows.
    """

    SUMMARY = "struct<starts: array<int>, ends: array<int>, targets: array<int>>"
    STATE = "int"

    @staticmethod
    def _runs(pairs: list[tuple[int, int, int]]) -> dict:
        starts, ends, targets = [], [], []
        for start, end, target in sorted(pairs):
            if ends and ends[-1] == start - 1 and targets[-1] == target:
                ends[-1] = end
            else:
                starts.append(start), ends.append(end), targets.append(target)
        return {"starts": starts, "ends": ends, "targets": targets}

    def summary(self, rows: list[tuple]) -> dict:
        leads: dict[int, int] = {}
        for (step,) in reversed(rows):
            leads[step - 1] = leads.get(step, step)
        return self._runs([(last, last, target) for last, target in leads.items()])

    def compose(self, first: dict, second: dict) -> dict:
        """``second`` after ``first``."""
        own = list(zip(first["starts"], first["ends"], first["targets"], strict=True))
        runs = [(start, end, self.advance(target, second)) for start, end, target in own]
        k = 0
        for start, end, target in zip(second["starts"], second["ends"], second["targets"], strict=True):
            while k < len(own) and own[k][1] < start:
                k += 1
            i = k
            while i < len(own) and own[i][0] <= end:  # what the first has moved does not enter here
                if start < own[i][0]:
                    runs.append((start, own[i][0] - 1, target))
                start = own[i][1] + 1
                i += 1
            if start <= end:
                runs.append((start, end, target))
        return self._runs(runs)

    def advance(self, state: int | None, summary: dict) -> int:
        last = state or 0
        i = int(np.searchsorted(summary["starts"], last, side="right")) - 1
        return summary["targets"][i] if i >= 0 and last <= summary["ends"][i] else last

    def step(self, state: int | None, row: tuple) -> tuple[int, tuple]:
        last, (step,) = state or 0, row
        accepted = step == last + 1
        return (step if accepted else last), (accepted, last + 1, step > 1 and last == 0)


class FixedWindowRate:
    """Count requests in a window that opens with its first request; reject over the limit.

    State: window start and count. Rows: (time,) as an integer. Output: window_start, request_no, allowed.

    A summary tells, by the first request that the entering window does not reach, which window the bucket ends in.
    Neighbours that end alike are one option: chains of windows meet, so few are left after some windows. A window that
    reaches over all requests takes their number along.
    """

    SUMMARY = "struct<times: array<bigint>, starts: array<bigint>, counts: array<bigint>, n: bigint, reach: bigint>"
    STATE = "struct<start: bigint, count: bigint>"

    def __init__(self, limit: int = V.RATE_LIMIT, window: int = V.RATE_WINDOW_SECONDS * 1_000_000):
        self.limit, self.window = limit, window

    def _options(self, times: np.ndarray, starts: np.ndarray, counts: np.ndarray, n: int, reach: int) -> dict:
        # an entering window starts before all requests: it cannot end after the first option beyond its reach
        used = min(len(times), int(np.searchsorted(times, reach, side="right")) + 1)
        times, starts, counts = times[:used], starts[:used], counts[:used]
        last = np.ones(used, dtype=bool)
        last[:-1] = (starts[1:] != starts[:-1]) | (counts[1:] != counts[:-1])
        return {"times": times[last].tolist(), "starts": starts[last].tolist(), "counts": counts[last].tolist(), "n": n, "reach": reach}

    def summary(self, rows: list[tuple]) -> dict:
        times = np.fromiter((t for (t,) in rows), dtype=np.int64, count=len(rows))
        n = len(times)
        # The last window of the chain that starts at each request, by doubling its links.
        following = np.searchsorted(times, times + self.window, side="right")
        last = np.where(following < n, following, np.arange(n))
        while not np.array_equal(last, last[last]):
            last = last[last]
        return self._options(times, times[last], n - last, n, int(times[0]) + self.window)

    def compose(self, first: dict, second: dict) -> dict:
        """``second`` after ``first``."""
        ended = [self.advance({"start": s, "count": c}, second) for s, c in zip(first["starts"], first["counts"], strict=True)]
        return self._options(
            np.array([*first["times"], *second["times"]], np.int64), np.array([*(e["start"] for e in ended), *second["starts"]], np.int64),
            np.array([*(e["count"] for e in ended), *second["counts"]], np.int64), first["n"] + second["n"], first["reach"])

    def advance(self, state: dict | None, summary: dict) -> dict:
        first = 0 if state is None else int(np.searchsorted(summary["times"], state["start"] + self.window, side="right"))
        if first < len(summary["times"]):
            return {"start": summary["starts"][first], "count": summary["counts"][first]}
        return {"start": state["start"], "count": state["count"] + summary["n"]}

    def step(self, state: dict | None, row: tuple) -> tuple[dict, tuple]:
        (now,) = row
        start, count = (state["start"], state["count"]) if state is not None else (now, 0)
        if now - start > self.window:
            start, count = now, 0
        count += 1
        return {"start": start, "count": count}, (start, count, count <= self.limit)


class ContextBinding:
    """Bind a session to the tab and frame of its first message until it ends or the tab closes.

    State: (tab, frame) or None. Rows: (event, tab, frame) with event send, end or
    tab_closed. Output: verdict (bound, ok, rejected, released, ignored).

    A summary has the state after an unbound entry, that after an entry which the session's end releases, and those of
    tabs that close before: one for each different tab.
    """

    STATE = "struct<tab: int, frame: int>"
    SUMMARY = (
        "struct<after: struct<tab: int, frame: int>, ended: boolean, at_end: struct<tab: int, frame: int>,"
        " tabs: array<int>, at_close: array<struct<tab: int, frame: int>>>"
    )

    def summary(self, rows: list[tuple]) -> dict:
        after: dict | None = None  # final state when nothing is bound before row i + 1
        ended, at_end, closed = False, None, {}
        for event, tab, frame in reversed(rows):
            if event == "send":
                after = self._leave({"tab": tab, "frame": frame}, ended, at_end, closed)
            elif event == "end":
                ended, at_end, closed = True, after, {}
            else:
                closed[tab] = after
        return self._packed(after, ended, at_end, closed)

    @staticmethod
    def _packed(after: dict | None, ended: bool, at_end: dict | None, closed: dict) -> dict:
        return {"after": after, "ended": ended, "at_end": at_end, "tabs": list(closed), "at_close": list(closed.values())}

    @staticmethod
    def _leave(bound: dict, ended: bool, at_end: dict | None, closed: dict) -> dict | None:
        return closed[bound["tab"]] if bound["tab"] in closed else at_end if ended else bound

    def compose(self, first: dict, second: dict) -> dict:
        """``second`` after ``first``."""
        closed = {tab: self.advance(s, second) for tab, s in zip(first["tabs"], first["at_close"], strict=True)}
        after = self.advance(first["after"], second)
        if first["ended"]:
            return self._packed(after, True, self.advance(first["at_end"], second), closed)
        return self._packed(after, second["ended"], second["at_end"], dict(zip(second["tabs"], second["at_close"], strict=True)) | closed)

    def advance(self, state: dict | None, summary: dict) -> dict | None:
        if state is None:
            return summary["after"]
        return self._leave(state, summary["ended"], summary["at_end"], dict(zip(summary["tabs"], summary["at_close"], strict=True)))

    def step(self, state: dict | None, row: tuple) -> tuple[dict | None, tuple]:
        event, tab, frame = row
        bound = {"tab": tab, "frame": frame}
        if event == "send":
            if state is None:
                return bound, ("bound",)
            return state, ("ok" if state == bound else "rejected",)
        if state is not None and (event == "end" or state["tab"] == tab):
            return None, ("released",)
        return state, ("ignored",)


class RequestChain(StepSequence):
    """A step enters the history when it follows the last one and its request was answered.

    State: the last step of the history. Rows: (step_number, answered, handled). Output: in_history, continuity_break
    (a handled later step while there is no history).
    """

    def summary(self, rows: list[tuple]) -> dict:
        return super().summary([(step,) for step, answered, _ in rows if answered])

    def step(self, state: int | None, row: tuple) -> tuple[int, tuple]:
        last, (step, answered, handled) = state or 0, row
        enters = bool(answered) and step == last + 1
        return (step if enters else last), (enters, bool(handled) and step > 1 and last == 0)
