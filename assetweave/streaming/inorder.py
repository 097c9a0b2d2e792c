"""Stateful jobs that take the events of a key in the order of their times, whatever trigger brings them.

Time is cut into spans. Events wait in state until the watermark has passed their span; an event-time timer, one a key, then
hands the spans on, one after another, each sorted. So results don't depend on how events are dealt to triggers, as long as none
comes later than the watermark allows; those are left out. A trigger of any size is held in chunks of bounded size, and
what a Python worker holds is a chunk, or a span of one key. State is meant for RocksDB, which state_store() puts in place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SPAN_MS = 60_000
#: Events of a key that a worker gathers before it puts them into state.
CHUNK = 20_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB) -> Iterator[None]:
    """Queries that are started within keep their state in this store; the session's setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class InOrder(StatefulProcessor):
    """kind: the numpy type of an event, with ts (microseconds) and id first. schema: that of the state at.

    Subclasses say what an event is (event), what the events of a span do (step), and when a state ends by itself (ends, end).
    """

    kind: np.dtype
    schema: str

    def __init__(self, span_ms: int = SPAN_MS):
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", self.schema)
        self.next = handle.getValueState("next", "ms long")
        self.chunks = handle.getMapState("chunks", "span long", "n int")
        self.held = handle.getMapState("held", "span long, chunk int", "events binary")

    def event(self, row: Row) -> tuple:
        raise NotImplementedError

    def step(self, key: tuple, at: tuple | None, events: np.ndarray, end_ms: int) -> tuple[tuple | None, list[Row]]:
        """The state after a span's events, in order, and the rows that it gives."""
        raise NotImplementedError

    def ends(self, at: tuple) -> int | None:
        """The time in milliseconds at which a state ends, if there is one."""
        return None

    def end(self, key: tuple, at: tuple) -> list[Row]:
        return []

    def _put(self, buffers: dict[int, list[tuple]]) -> None:
        for span, events in buffers.items():
            n = self.chunks.getValue((span,))
            n = n[0] if n else 0
            self.held.updateValue((span, n), (np.array(events, self.kind).tobytes(),))
            self.chunks.updateValue((span,), (n + 1,))
        buffers.clear()

    def _wake(self, ms: int | None) -> None:
        """Moves the key's timer to a time, if it isn't there."""
        before = self.next.get()[0] if self.next.exists() else None
        if ms == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if ms is None:
            self.next.clear()
        else:
            self.handle.registerTimer(ms)
            self.next.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed, buffers, n = timerValues.getCurrentWatermarkInMs(), defaultdict(list), 0
        first = self.next.get()[0] if self.next.exists() else None
        for row in rows:
            event = self.event(row)
            span = event[0] // (1000 * self.span_ms)
            end = (span + 1) * self.span_ms
            if end <= passed:
                continue
            first = end if first is None else min(first, end)
            buffers[span].append(event)
            n += 1
            if n % CHUNK == 0:
                self._put(buffers)
        self._put(buffers)
        self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        at = self.at.get() if self.at.exists() else None
        at = tuple(at) if at is not None else None
        spans = sorted(m for (m,) in self.chunks.keys())
        over = [m for m in spans if (m + 1) * self.span_ms <= passed]
        for span in over:
            n = self.chunks.getValue((span,))[0]
            events = np.concatenate([np.frombuffer(self.held.getValue((span, k))[0], self.kind) for k in range(n)])
            at, out = self.step(key, at, events[np.lexsort((events["id"], events["ts"]))], (span + 1) * self.span_ms)
            yield from out
            for k in range(n):
                self.held.removeKey((span, k))
            self.chunks.removeKey((span,))
        if at is not None and (ends := self.ends(at)) is not None and ends <= passed:
            yield from self.end(key, at)
            at = None
        if at is None:
            self.at.clear()
        else:
            self.at.update(at)
        # the timer that has come is gone
        self.next.clear()
        times = [(m + 1) * self.span_ms for m in spans[len(over) : len(over) + 1]] + [e for e in [at and self.ends(at)] if e is not None]
        if times:
            self._wake(min(times))

    def close(self) -> None:
        pass
