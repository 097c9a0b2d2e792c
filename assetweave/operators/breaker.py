"""The circuit breaker of each source, folded over its calls in order, in parallel.

A breaker goes from state to state call by call, so its calls can't be folded apart unless the state that a piece of them begins with is
known. Here each piece is folded at once from every state that it can begin with, which gives the function of the piece:

- closed with 0 to threshold - 1 failures, half-open with 0 to SUCCESSES - 1 wins;
- open until some time: it then is half-open after the first call at or after that time. As no breaker that is open when a
  piece begins stays so for longer than the timeout, the calls within the timeout of the piece's first give all cases.

Runs that meet go on as one, so that soon few are left, whatever the number of starts; at the most a start is held for each
call within the timeout of a piece's first. Failures go on counting
while a breaker isn't closed; runs that are alike but for that count are one run with an offset for each start. The
functions of the pieces, a few rows a source, are then composed in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILURES, TIMEOUT_S, SUCCESSES = 6, 60, 3
CLOSED, HALF_OPEN, OPEN = "closed", "half-open", "open"
#: A breaker as (state, failures, wins, retry, opened); retry is a time in microseconds, 0 unless it is open.
FRESH = (CLOSED, 0, 0, 0, 0)


def breaker_step(at: tuple, ts: int, ok: bool, threshold: int, timeout_us: int) -> tuple:
    """The breaker after one call at ts, in microseconds."""
    state, failures, wins, retry, opened = at
    if ok and state == HALF_OPEN:
        wins += 1
        if wins >= SUCCESSES:
            state, failures, wins = CLOSED, 0, 0
    elif ok and state == CLOSED:
        failures = max(0, failures - 1)
    elif not ok:
        failures, wins = failures + 1, 0
        if state == HALF_OPEN or state == CLOSED and failures >= threshold:
            state, retry, opened = OPEN, ts + timeout_us, opened + 1
    if state == OPEN and ts >= retry:
        state, retry = HALF_OPEN, 0
    return state, failures, wins, retry, opened


@dataclass(slots=True)
class Member:
    """A start of a run: its kind and number, for open ones the time of the last
    call at which they are due, after that of the open start before; base failures are to be added to those of the start if it is relative; opened are the openings of the run before this start joined it."""

    kind: str
    number: int = 0
    upto: int = 0
    relative: bool = False
    base: int = 0
    opened: int = 0


@dataclass(slots=True)
class Run:
    """A breaker on its way and the starts that lead to it. While it isn't closed its failures are those of a member and
    all of the piece so far."""

    at: tuple
    members: list[Member] = field(default_factory=list)

    def met(self, new: Run) -> Run:
        """This run with the starts of another that is in the same state."""
        if len(new.members) > len(self.members):
            return new.met(self)
        for m in new.members:
            m.opened += new.at[4] - self.at[4]
        self.members += new.members
        return self


class PieceFold:
    """The function of a piece of calls, given one by one in order. whole: nothing comes before, so it begins closed.

    Runs that are open wait, in the order in which they are due; only the others look at each call, and they are as many
    as there are closed and half-open states at the most.
    """

    def __init__(self, threshold: int, timeout_us: int, whole: bool):
        self.threshold, self.timeout_us = threshold, timeout_us
        self.failed = 0
        self.first: int | None = None
        self.due: Member | None = None
        self.takes_due = not whole
        self.waiting: deque[Run] = deque()
        starts = [Run(FRESH, [Member(CLOSED)])]
        if not whole:
            starts += [Run((CLOSED, k, 0, 0, 0), [Member(CLOSED, k)]) for k in range(1, threshold)]
            starts += [Run((HALF_OPEN, 0, w, 0, 0), [Member(HALF_OPEN, w, relative=True)]) for w in range(SUCCESSES)]
        self.runs: dict[int, Run] = {}
        for run in starts:
            self._join(run)

    def _join(self, run: Run) -> None:
        """Adds a run that isn't open, to the one in its state if there is one."""
        key = run.at[1] if run.at[0] == CLOSED else -1 - run.at[2]
        other = self.runs.get(key)
        self.runs[key] = run if other is None else other.met(run)

    def add(self, ts: int, ok: bool) -> None:
        if self.first is None:
            self.first = ts
        self.failed += not ok
        old, self.runs, opened = self.runs, {}, None
        for run in old.values():
            before = run.at[0]
            run.at = breaker_step(run.at, ts, ok, self.threshold, self.timeout_us)
            if run.at[0] == CLOSED and before != CLOSED:
                for m in run.members:
                    m.relative, m.base = False, 0
            elif before == CLOSED and run.at[0] != CLOSED:
                for m in run.members:
                    m.base = run.at[1] - self.failed
            if run.at[0] == OPEN:
                opened = run if opened is None else opened.met(run)
            else:
                self._join(run)
        while self.waiting and self.waiting[0].at[3] <= ts:
            run = self.waiting.popleft()
            run.at = (HALF_OPEN, 0, 0, 0, run.at[4])
            self._join(run)
        if opened is not None:
            self.waiting.append(opened)
        if self.takes_due and (self.due is None or ts > self.due.upto):
            self._due(ts)
            self.takes_due = ts < self.first + self.timeout_us

    def _due(self, ts: int) -> None:
        """Adds the start of a breaker that was open before the piece and is due at the call at ts."""
        run = self.runs.get(-1)
        if run is not None and run.members[-1] is self.due and self.due.relative and self.due.base == 0 and run.at[4] + self.due.opened == 0:
            self.due.upto = ts  # as if it had been due at the call before
            return
        self.due = Member(OPEN, 0, ts, True)
        self._join(Run((HALF_OPEN, 0, 0, 0, 0), [self.due]))

    def rows(self) -> list[dict]:
        """The piece's function: of each start the state at the end."""
        out = []
        for run in [*self.runs.values(), *self.waiting]:
            state, failures, wins, retry, opened = run.at
            for m in run.members:
                end = failures if state == CLOSED else m.base + self.failed
                out.append({"kind": m.kind, "number": m.number, "upto": m.upto, "state": state, "failures": end, "relative": m.relative, "wins": wins, "retry": retry, "opened": opened + m.opened})
        return out


def composed(at: tuple, failed: int, ends: list[dict]) -> tuple:
    """The breaker after a piece that it begins with at."""
    state, failures, wins, retry, opened = at
    if state == OPEN:
        due = min((e for e in ends if e["kind"] == OPEN and e["upto"] >= retry), key=lambda e: e["upto"], default=None)
        if due is None:
            return state, failures + failed, wins, retry, opened
        end = due
    else:
        number = failures if state == CLOSED else wins
        end = next(e for e in ends if e["kind"] == state and e["number"] == number)
    return end["state"], end["failures"] + (failures if end["relative"] else 0), end["wins"], end["retry"], opened + end["opened"]


START = pa.struct([("kind", pa.string()), ("number", pa.int64()), ("upto", pa.int64()), ("state", pa.string()), ("failures", pa.int64()), ("relative", pa.bool_()), ("wins", pa.int64()), ("retry", pa.int64()), ("opened", pa.int64())])
PIECE = pa.schema([("source", pa.string()), ("piece", pa.int32()), ("failed", pa.int64()), ("ends", pa.list_(START))])
PIECE_DDL = "source string, piece int, failed long, ends array<struct<kind:string,number:long,upto:long,state:string,failures:long,relative:boolean,wins:long,retry:long,opened:long>>"


def folded(calls: DataFrame, threshold: int = FAILURES, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """(source, state, failures, opened): the breaker after all calls (source, ts, id, success) of each source.

    The calls are dealt by ranges of (source, ts, id), so that a source with most of them is shared out over all tasks;
    each range is read once, in order, call by call. A source that begins within a range has nothing before.
    """
    spark, timeout_us = calls.sparkSession, int(timeout_s * 1e6)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, source, now, begun = TaskContext.get().partitionId(), None, None, False
        row = lambda: pa.RecordBatch.from_pylist([{"source": source, "piece": piece, "failed": now.failed, "ends": now.rows()}], schema=PIECE)
        for batch in batches:
            for of, ts, ok in zip(*(batch[c].to_pylist() for c in ("source", "ts", "success")), strict=True):
                if now is None or of != source:
                    if now is not None:
                        yield row()
                    source, now, begun = of, PieceFold(threshold, timeout_us, begun), True
                now.add(ts, ok)
        if now is not None:
            yield row()

    def compose(rows: pa.Table) -> pa.Table:
        at = FRESH
        for r in sorted(rows.to_pylist(), key=lambda r: r["piece"]):
            at = composed(at, r["failed"], r["ends"])
        return pa.table({"source": rows["source"].slice(0, 1), "state": [at[0]], "failures": pa.array([at[1]], pa.int32()), "opened": pa.array([at[4]], pa.int32())})

    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = calls.select("source", ts.alias("ts"), "id", F.coalesce("success", F.lit(False)).alias("success"))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "source", "ts", "id").sortWithinPartitions("source", "ts", "id")
    return dealt.mapInArrow(fold, PIECE_DDL).groupBy("source").applyInArrow(compose, "source string, state string, failures int, opened int")
