"""The stateful streams against loops over all events, whatever triggers bring them."""

import random

import pytest
from pyspark.sql import functions as F

from assetweave.operators import health
from assetweave.operators.breaker import FRESH, breaker_step
from assetweave.streaming import inorder, jobs

SPAN = 60_000
CALLS = "id long, source string, t long, success boolean, duration double"


def calls(seed, n=240):
    rng = random.Random(seed)
    return [(k, "hot" if rng.random() < 0.8 else "cold", 1_700_000_000 + 7 * k, rng.random() < 0.5, rng.choice([None, 0.0, 5.0, 40_000.0])) for k in range(n)]


def land(spark, path, rows):
    """The rows as one file, their times in seconds."""
    df = spark.createDataFrame(rows, CALLS).select("id", "source", F.timestamp_seconds("t").alias("ts"), "success", "duration")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def triggers(rows, seed, size):
    """The rows in triggers: in the order of time, but shuffled over some minutes."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 240))
    return [late[k : k + size] for k in range(0, len(late), size)]


def looped(rows, threshold):
    """Rows of changes and of spans' ends, of the spans that the watermark has passed at the end."""
    mark = max(r[2] for r in rows) * 1000 - 600_000
    out = set()
    for source in {r[1] for r in rows}:
        at, n, errors, streak, timed, total = FRESH, 0, 0, 0, 0, 0.0
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[2], r[0]))
        for k, (_, _, t, ok, ms) in enumerate(own):
            end = (t * 1000 // SPAN + 1) * SPAN
            before, at = at, breaker_step(at, t * 1_000_000, ok, threshold, 60_000_000)
            n, errors, streak = n + 1, errors + (not ok), 0 if ok else streak + 1
            if ms:
                timed, total = timed + 1, total + ms
            score = round(jobs.score(at[0], errors / n, streak, total / timed if timed else 0.0), 6)
            if end <= mark and before[0] != at[0]:
                out.add((source, t * 1000, before[0], at[0], at[1], at[4], score))
            if end <= mark and (k + 1 == len(own) or own[k + 1][2] * 1000 // SPAN != t * 1000 // SPAN):
                out.add((source, end, None, at[0], at[1], at[4], score))
    return out


def run(spark, tmp_path, name, parts, threshold=3):
    path, target = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    for part in parts:
        for rows in part:
            schema = land(spark, path, rows)
        stream = jobs.stream_breaker(jobs.read_stream(spark, path, schema, files=1), threshold)
        jobs.publish(stream, target, str(tmp_path / f"{name}-progress")).awaitTermination()
    got = spark.read.parquet(target).select("source", F.unix_millis("ts").alias("ts"), "from_state", "state", "failures", "opened", F.round("score", 6).alias("score")).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_breaker_does_not_depend_on_triggers(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    rows = calls(1)
    wanted = looped(rows, 3)
    assert len(wanted) > 20
    assert run(spark, tmp_path, "one", [[rows]]) == wanted
    monkeypatch.setattr(inorder, "CHUNK", 3)
    assert run(spark, tmp_path, "some", [triggers(rows, 5, 60)]) == wanted
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_breaker_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = calls(2)
    parts = triggers(rows, 6, 80)
    assert run(spark, tmp_path, "again", [parts[:1], parts[1:]]) == looped(rows, 3)


def test_last_score_is_that_of_the_batch_job(spark, tmp_path):
    rows = calls(3)
    # a last call that lies far ahead lets the watermark pass all others
    got = run(spark, tmp_path, "score", [[rows, [(9999, "late", rows[-1][2] + 10_000, True, 1.0)]]], threshold=6)
    last = {}
    for r in sorted(got, key=lambda r: (r[1], r[2] is None)):
        last[r[0]] = r[6]
    log = spark.createDataFrame(rows, CALLS).select("id", "source", F.timestamp_seconds("t").alias("ts"), "success", "duration")
    assert last == {r.source: pytest.approx(r.score) for r in health.health_scores(log).collect()}


def test_alerts_open_upgrade_resolve_and_expire(spark, tmp_path):
    path, target, day = str(tmp_path / "in"), str(tmp_path / "out"), 86_400
    rows = [("a", "x", "warning", 100, 1), ("a", "x", "info", 110, 2), ("a", "x", "critical", 400, 3), ("a", "x", None, 500, 4), ("a", "x", "info", 900, 5), ("b", "x", "error", 1000, 6), ("b", "x", "info", 3 * day, 7), ("c", "x", None, 9 * day, 8)]
    for part in (rows[:6], rows[6:]):
        df = spark.createDataFrame(part, "source string, type string, level string, t long, id long").select("source", "type", "level", F.timestamp_seconds("t").alias("ts"), "id")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_stream(spark, path, df.schema, files=1).withWatermark("ts", jobs.LATENESS)
    jobs.publish(jobs.stream_alerts(stream, 2), target, str(tmp_path / "progress")).awaitTermination()
    got = sorted((r.source, r.event, r.level, r.t) for r in spark.read.parquet(target).withColumn("t", F.unix_seconds("ts")).collect())
    assert got == sorted([("a", "opened", "warning", 100), ("a", "upgraded", "critical", 400), ("a", "resolved", "critical", 500), ("a", "opened", "info", 900), ("a", "expired", "info", 900), ("b", "opened", "error", 1000), ("b", "expired", "error", 1000), ("b", "opened", "info", 3 * day), ("b", "expired", "info", 3 * day)])


def test_percentiles_of_windows_within_their_error(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, "hot", 1_700_000_000 + k // 4, True, rng.choice([0.0, rng.expovariate(0.01)])) for k in range(12_000)]
    path, target, accuracy = str(tmp_path / "in"), str(tmp_path / "out"), 50
    for part in triggers(rows, 7, 3000):
        schema = land(spark, path, part)
    jobs.publish(jobs.stream_latency_1h(jobs.read_stream(spark, path, schema, files=1), accuracy), target, str(tmp_path / "progress"), "complete").awaitTermination()
    got = spark.read.parquet(target).withColumn("t", F.unix_seconds("start")).collect()
    assert len(got) > 10
    for r in got:
        own = sorted(ms for _, _, t, _, ms in rows if r.t <= t < r.t + 3600 and ms > 0)
        for q, v in ((0.5, r.median), (0.95, r.p95), (0.99, r.p99)):
            assert abs(own.index(v) + 1 - q * len(own)) <= len(own) / accuracy + 1
