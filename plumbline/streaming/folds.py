"""Per-run folds over closed pieces, as stateful processors.

A piece (the rows of a run in one window of event time) reaches a processor once,
after the watermark has passed its end, and pieces that close together come in
one call. Spark's own windowed aggregate holds what is still open, so a run's
state is a few numbers whatever its number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MILLIS = 1000


class EmaFold(StatefulProcessor):
    """Moving averages of step means, carried from step to step of a run.

    Pieces hold (end, step, n, sums and counts of the axes). A step may span
    several pieces; it is closed by a piece of a later step, or once the
    watermark has passed its last piece by `quiet_ms`. Then it leaves once. A
    piece of a step that is closed already leaves as a late row and moves nothing.
    """

    def __init__(self, run: str, axes: list[str], alpha: float, start: float | None, quiet_ms: int):
        self.run, self.axes, self.alpha, self.start, self.quiet = run, axes, alpha, start, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        numbers = "array<double>"
        self.held = handle.getValueState(
            "held", f"step bigint, end bigint, n bigint, sums {numbers}, counts {numbers}, closed bigint, carry {numbers}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self._state()
        out: list[tuple] = []
        pieces = pd.concat(list(rows), ignore_index=True)
        pieces = pieces.sort_values(["end", "step"], kind="stable")
        sums, counts = ([f"{k}_{a}" for a in self.axes] for k in "sc")
        for end, step, n, s, c in zip(pieces["end"], pieces["step"], pieces["n"],
                                      pieces[sums].fillna(0.0).to_numpy(float), pieces[counts].to_numpy(float)):
            if now["closed"] is not None and step <= now["closed"] or now["step"] is not None and step < now["step"]:
                out.append((step, n, *_means(s, c), *[None] * len(self.axes), True))
                continue
            if now["step"] is not None and step > now["step"]:
                out += self._close(now)
            if now["step"] is None:
                now |= {"step": int(step), "end": int(end), "n": 0, "sums": np.zeros(len(s)), "counts": np.zeros(len(c))}
            now["end"], now["n"] = max(now["end"], int(end)), now["n"] + int(n)
            now["sums"], now["counts"] = now["sums"] + s, now["counts"] + c
        if now["step"] is not None:
            if timerValues.getCurrentWatermarkInMs() >= now["end"] + self.quiet:
                out += self._close(now)
            else:
                self.handle.registerTimer(now["end"] + self.quiet)
        self._keep(now)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._state()
        due = expiredTimerInfo.getExpiryTimeInMs()
        # A later piece of the step has set a timer of its own.
        out = self._close(now) if now["step"] is not None and now["end"] + self.quiet <= due else []
        self._keep(now)
        if out:
            yield self._frame(key, out)

    def _close(self, now: dict) -> list[tuple]:
        means = _means(now["sums"], now["counts"])
        complete = all(m is not None for m in means)
        if complete:
            before = now["carry"]
            if before is None:
                before = means if self.start is None else [self.start] * len(means)
            now["carry"] = [self.alpha * m + (1 - self.alpha) * b for m, b in zip(means, before)]
        row = (now["step"], now["n"], *means, *(now["carry"] if complete else [None] * len(means)), False)
        now |= {"closed": now["step"], "step": None}
        return [row]

    def _state(self) -> dict:
        names = ["step", "end", "n", "sums", "counts", "closed", "carry"]
        if not self.held.exists():
            return dict.fromkeys(names)
        now = dict(zip(names, self.held.get()))
        for c in ("sums", "counts"):
            now[c] = None if now[c] is None else np.array(now[c], float)
        return now

    def _keep(self, now: dict) -> None:
        listed = {c: None if now[c] is None else [float(x) for x in now[c]] for c in ("sums", "counts", "carry")}
        self.held.update((now["step"], now["end"], now["n"], listed["sums"], listed["counts"], now["closed"], listed["carry"]))

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        columns = ["step", "n", *self.axes, *[f"ema_{a}" for a in self.axes], "late"]
        frame = pd.DataFrame(out, columns=columns)
        frame.insert(0, self.run, key[0])
        return frame

    def close(self) -> None:
        pass


def _means(sums: np.ndarray, counts: np.ndarray) -> list[float | None]:
    return [float(s / c) if c else None for s, c in zip(sums, counts)]


class AlarmFold(StatefulProcessor):
    """The first failed call of a run at which the error rate is above the threshold.

    A run's state is the calls and errors of its closed pieces and whether its
    alarm has left. Pieces bring the failed calls that can be the first one.
    """

    def __init__(self, run: str, order: list[str], threshold: float, min_calls: int):
        self.run, self.order, self.threshold, self.min_calls = run, order, threshold, min_calls

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "calls bigint, errors bigint, raised boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls, errors, raised = self.held.get() if self.held.exists() else (0, 0, False)
        out = []
        if not raised:
            pieces = pd.concat(list(rows), ignore_index=True).sort_values("end", kind="stable")
            for n, failed, records in zip(pieces["calls"], pieces["errors"], pieces["records"]):
                first = next((r for r in records if calls + r["c"] >= self.min_calls
                              and (errors + r["e"]) / (calls + r["c"]) > self.threshold), None)
                if first is not None:
                    out.append((*[first[o] for o in self.order], errors + int(first["e"]), calls + int(first["c"])))
                    raised = True
                    break
                calls, errors = calls + int(n), errors + int(failed)
        self.held.update((int(calls), int(errors), raised))
        if out:
            frame = pd.DataFrame(out, columns=[*self.order, "errors", "calls"])
            frame.insert(0, self.run, key[0])
            yield frame

    def close(self) -> None:
        pass


def first_calls(failed: np.ndarray, threshold: float, min_calls: int) -> np.ndarray:
    """Places of the failed calls of a piece that may raise the alarm, whatever came before.

    With C calls and E errors before, call i raises it if E - t*C > t*c - e at i
    and C + c reaches the least number. So only a call below all earlier ones in
    t*c - e can be the first, except among those that the least number may rule
    out, which all stay.
    """
    place = np.flatnonzero(failed)
    c, e = place + 1, np.arange(1, len(place) + 1)
    below = threshold * c - e
    early = c < min_calls
    lowest = np.minimum.accumulate(np.where(early, np.inf, below))
    before = np.concatenate([[np.inf], lowest[:-1]])
    # A little slack: rounding must not drop a call; one too many does no harm.
    return place[early | (below <= before + 1e-6)]
