"""A queue of jobs for each key, worked off one at a time, with versions and a time limit.

Requests come as a stream: ``put`` asks for an item to be done, ``done`` reports it. One item of a key runs at any time, the others wait in
order. A newer version of an item takes the place of an older one, whether that waits or runs. A report of a version that isn't the
running one is stale and changes nothing. An item that runs for ``limit`` without a report is given up, and the next starts.

State is a list of what waits and a value for what runs, in Spark's state store under the query's checkpoint; timers are Spark's own. A key with
nothing to do has no state, so dead keys cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "key string, item string, version long, event string, at timestamp"


class _Queue(StatefulProcessor):
    def __init__(self, limit_ms: int) -> None:
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "item string, version long")
        self.running = handle.getValueState("running", "item string, version long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        frame = pd.concat(list(rows)).sort_values(["at", "op", "item", "version"], kind="stable")
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        running = tuple(self.running.get()) if self.running.exists() else None
        before = running
        for op, item, version, at in zip(frame["op"], frame["item"], frame["version"].astype("int64"), frame["at"], strict=True):
            now = int(at.value // 1_000_000)
            while running and running[2] <= now:  # its time was up before this request
                running = self._next(key[0], waiting, running, out)
            if op == "put":
                known = [v for i, v in waiting if i == item] + ([running[1]] if running and running[0] == item else [])
                newest = max(known, default=None)
                if newest is not None and version <= newest:
                    out.append((key[0], item, version, "stale", at))
                elif running and running[0] == item:
                    running = (item, version, now + self.limit)
                    out.append((key[0], item, version, "started", at))
                elif newest is not None:
                    waiting = [(i, version if i == item else v) for i, v in waiting]
                else:
                    waiting.append((item, version))
            elif running and (item, version) == running[:2]:
                out.append((key[0], item, version, "done", at))
                running = None
            else:
                out.append((key[0], item, version, "stale", at))
            if running is None and waiting:
                running = (*waiting.pop(0), now + self.limit)
                out.append((key[0], running[0], running[1], "started", at))
        self._keep(waiting, running, before)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        running = tuple(self.running.get()) if self.running.exists() else None
        if running is None or running[2] != until:
            yield _frame([])
            return
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        out: list[tuple] = []
        self._keep(waiting, self._next(key[0], waiting, running, out), None)
        yield _frame(out)

    def _next(self, key: str, waiting: list[tuple], running: tuple, out: list[tuple]) -> tuple | None:
        """Give up what runs and start the next, if any, at the moment its time was up."""
        at = pd.Timestamp(running[2], unit="ms")
        out.append((key, running[0], running[1], "given up", at))
        if not waiting:
            return None
        out.append((key, *waiting[0], "started", at))
        return (*waiting.pop(0), running[2] + self.limit)

    def _keep(self, waiting: list[tuple], running: tuple | None, before: tuple | None) -> None:
        if before and before != running:
            self.handle.deleteTimer(before[2])
        if running and running != before:
            self.handle.registerTimer(running[2])
        if running:
            self.running.update(running)
        elif self.running.exists():
            self.running.clear()
        if waiting:
            self.waiting.put(waiting)
        elif self.waiting.exists():
            self.waiting.clear()

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["key", "item", "version", "event", "at"])
    return frame.astype({"key": "object", "item": "object", "version": "int64", "event": "object", "at": "datetime64[us]"})


def serial_queue(requests: DataFrame, limit: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """(key, item, version, event, at) of a stream (key, op, item, version, at): what is started, done, stale or given up.

    ``op``: put or done. ``at`` is the time of a request; time goes on with the stream's watermark, which is ``late``
    behind, and a request later than that is dropped by Spark before it gets here. Requests of a micro-batch are taken by ``at``; at one moment
    reports come before new items. Rows with a null are left out. ``limit`` is an interval.
    """
    limit_ms = int(pd.Timedelta(limit).total_seconds() * 1000)
    whole = requests.dropna(subset=["key", "op", "item", "version", "at"]).withWatermark("at", late)
    plain = whole.selectExpr("cast(key as string) key", "op", "cast(item as string) item", "cast(version as long) version", "at")
    return plain.groupBy("key").transformWithStateInPandas(statefulProcessor=_Queue(limit_ms), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
