"""Structured Streaming forms of the call-log jobs. Event time stands for the clock, so results can be repeated.

Each job takes a streaming frame and returns one; start() runs it with a checkpoint. Late rows beyond the watermark are
dropped by the windows; the stateful jobs take a key's events in the order of their times, span by span.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetweave.operators.breaker import FAILURES, FRESH, HALF_OPEN, OPEN, TIMEOUT_S, breaker_step
from assetweave.operators.health import LEVELS, SLOW_MS
from assetweave.sources.versions import KeyedTable
from assetweave.streaming.inorder import SPAN_MS, InOrder, state_store

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LATENESS = "10 minutes"


#: Ranks of the percentiles of a window are right to one part in so many of its calls.
ACCURACY = 10_000


def stream_latency_1h(log: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """Calls, errors and durations of each source in hours that begin every five minutes.

    median, p95 and p99 are of durations above 0, as latency_stats has them: a window keeps a quantile sketch, which merges and takes
    late and reordered calls; the rank of what it gives is off by a part in accuracy of the window's calls at the most.
    """
    hours = log.withWatermark("ts", LATENESS).groupBy("source", F.window("ts", "1 hour", "5 minutes").alias("w"))
    sketch = F.percentile_approx(F.when(F.col("duration") > 0, F.col("duration")), [0.5, 0.95, 0.99], accuracy).alias("p")
    got = hours.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("errors"), F.sum("duration").alias("total_ms"), F.max("duration").alias("most_ms"), sketch)
    return got.select("source", F.col("w.start").alias("start"), "n", "errors", "total_ms", "most_ms", F.get("p", F.lit(0)).alias("median"), F.get("p", F.lit(1)).alias("p95"), F.get("p", F.lit(2)).alias("p99"))


def stream_conflict_rate(log: DataFrame) -> DataFrame:
    """Failures in hours that begin every quarter."""
    return log.where("NOT success").withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


class Breaker(InOrder):
    """A source's breaker and what its score is made of."""

    kind = np.dtype([("ts", "i8"), ("id", "i8"), ("ok", "?"), ("ms", "f8")])
    schema = "state string, failures long, wins long, retry long, opened long, n long, errors long, streak long, timed long, total_ms double"

    def __init__(self, threshold: int, timeout_s: float, span_ms: int):
        super().__init__(span_ms)
        self.threshold, self.timeout_us = threshold, int(timeout_s * 1e6)

    def event(self, row: Row) -> tuple:
        return row.us, row.id if row.id is not None else -1, bool(row.success), row.duration or 0.0

    def step(self, key: tuple, at: tuple | None, events: np.ndarray, end_ms: int) -> tuple[tuple, list[Row]]:
        breaker, (n, errors, streak, timed, total) = (FRESH, (0, 0, 0, 0, 0.0)) if at is None else (at[:5], at[5:])
        out = []
        row = lambda us, before: Row(source=key[0], us=us, from_state=before, state=breaker[0], failures=breaker[1], opened=breaker[4], score=score(breaker[0], errors / n, streak, total / timed if timed else 0.0))
        for us, _, ok, ms in events.tolist():
            before, breaker = breaker[0], breaker_step(breaker, us, ok, self.threshold, self.timeout_us)
            n, errors, streak = n + 1, errors + (not ok), 0 if ok else streak + 1
            if ms > 0:
                timed, total = timed + 1, total + ms
            if breaker[0] != before:
                out.append(row(us, before))
        out.append(row(end_ms * 1000, None))
        return (*breaker, n, errors, streak, timed, total), out


def score(state: str, error_rate: float, streak: int, mean_ms: float) -> float:
    """A source's health, 0 to 100, as health_scores has it."""
    raw = 100 - 50 * error_rate - min(40, 10 * streak) - (20 if mean_ms > SLOW_MS else 0)
    return float(max(0.0, min(100.0, 0.0 if state == OPEN else raw * 0.5 if state == HALF_OPEN else raw)))


def stream_breaker(log: DataFrame, threshold: int = FAILURES, timeout_s: float = TIMEOUT_S, span_ms: int = SPAN_MS) -> DataFrame:
    """Rows (source, ts, from_state, state, failures, opened, score) for each change of a source's breaker, and one for each
    span of time with calls, at its end, with from_state null. A span counts once the watermark is past it."""
    calls = log.withWatermark("ts", LATENESS).select("source", "id", "ts", F.unix_micros("ts").alias("us"), "success", "duration")
    rows = calls.groupBy("source").transformWithState(Breaker(threshold, timeout_s, span_ms), "source string, us long, from_state string, state string, failures long, opened long, score double", "Append", "EventTime")
    return rows.select("source", F.timestamp_micros("us").alias("ts"), "from_state", "state", "failures", "opened", "score")


class Alerts(InOrder):
    """The open alert of a (source, type), if there is one: its level and since when."""

    kind = np.dtype([("ts", "i8"), ("id", "i8"), ("level", "i4")])
    schema = "level int, first long"

    def __init__(self, retention_days: float, span_ms: int):
        super().__init__(span_ms)
        self.kept = int(retention_days * 86_400_000_000)

    def event(self, row: Row) -> tuple:
        return row.us, row.id if row.id is not None else -1, -1 if row.level is None else LEVELS[row.level]

    def step(self, key: tuple, at: tuple | None, events: np.ndarray, end_ms: int) -> tuple[tuple | None, list[Row]]:
        out, names = [], list(LEVELS)
        put = lambda event, level, us: out.append(Row(source=key[0], type=key[1], event=event, level=names[level], us=us))
        for us, _, new in events.tolist():
            if at is not None and at[1] + self.kept <= us:
                put("expired", *at)
                at = None
            if new < 0:
                if at is not None:
                    put("resolved", at[0], us)
                at = None
            elif at is None or new > at[0]:
                put("opened" if at is None else "upgraded", new, us)
                at = (new, us)
        return at, out

    def ends(self, at: tuple) -> int:
        return (at[1] + self.kept) // 1000 + 1

    def end(self, key: tuple, at: tuple) -> list[Row]:
        return [Row(source=key[0], type=key[1], event="expired", level=list(LEVELS)[at[0]], us=at[1])]


def stream_alerts(alerts: DataFrame, retention_days: float = 7, span_ms: int = SPAN_MS) -> DataFrame:
    """Rows (source, type, event, level, ts) as alerts of (source, type) are opened, upgraded, resolved and expire.

    alerts: source, type, level (null: recovered), ts, id, with a watermark on ts. An alert expires when it is older than
    the retention at the next event of its key, or when the watermark gets there; the row has the alert's own ts.
    """
    rows = alerts.select("source", "type", "level", "ts", F.unix_micros("ts").alias("us"), "id")
    rows = rows.groupBy("source", "type").transformWithState(Alerts(retention_days, span_ms), "source string, type string, event string, level string, us long", "Append", "EventTime")
    return rows.select("source", "type", "event", "level", F.timestamp_micros("us").alias("ts"))


def publish(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Writes each trigger's rows as a folder of target; in complete mode the folder is replaced. A trigger that is
    run again after a failure writes the same folder again."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={0 if mode == 'complete' else number}")

    with state_store(stream.sparkSession):
        return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


def stream_refresh(snapshots: DataFrame, table: KeyedTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Puts each trigger's snapshot rows into the table, which merges the keys that they touch again over all sources
    and publishes a version. A trigger without rows leaves the last version as it is; a repeated one changes nothing."""

    def put(rows: DataFrame, number: int) -> None:
        table.put(rows, number)

    return snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"processingTime": "15 minutes"})).start()


def stream_schema_drift(raw: DataFrame, check, target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Violations of each trigger's new payloads, added to target."""

    def put(rows: DataFrame, number: int) -> None:
        check(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


def read_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """New Parquet files under path; files: at most so many a trigger."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
