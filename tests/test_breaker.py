"""The parallel fold of the breaker against the loop over all calls."""

import random

import pytest
from pyspark.sql import functions as F

from assetweave.operators import health
from assetweave.operators.breaker import CLOSED, FRESH, HALF_OPEN, OPEN, SUCCESSES, PieceFold, breaker_step, composed, folded


def looped(calls, threshold, timeout, at=FRESH):
    for ts, ok in calls:
        at = breaker_step(at, ts, ok, threshold, timeout)
    return at


def some_calls(rng):
    ts, p, step, out = 0, rng.choice([0.2, 0.5, 0.8]), rng.choice([1, 10, 40]), []
    for _ in range(rng.randint(1, 150)):
        ts += rng.choice([0, 0, 1, step])
        out.append((ts, rng.random() > p))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_pieces_cut_anywhere_compose_to_the_loop(seed):
    rng = random.Random(seed)
    for _ in range(200):
        calls, threshold, timeout = some_calls(rng), rng.choice([1, 2, 3, 6]), rng.choice([0, 5, 60, 500])
        cuts = sorted(rng.sample(range(1, len(calls)), min(len(calls) - 1, rng.randint(0, 8))))
        at = FRESH
        for k, (low, high) in enumerate(zip([0, *cuts], [*cuts, None], strict=True)):
            piece = PieceFold(threshold, timeout, k == 0 and rng.random() < 0.5)
            for c in calls[low:high]:
                piece.add(*c)
            at = composed(at, piece.failed, piece.rows())
        assert at == looped(calls, threshold, timeout)


def test_a_piece_is_a_function_of_every_start():
    rng = random.Random(8)
    for _ in range(100):
        calls, threshold, timeout = some_calls(rng), rng.choice([2, 6]), rng.choice([5, 60])
        piece = PieceFold(threshold, timeout, False)
        for c in calls:
            piece.add(*c)
        starts = [(CLOSED, k, 0, 0, 0) for k in range(threshold)] + [(HALF_OPEN, 7, w, 0, 2) for w in range(SUCCESSES)] + [(OPEN, 9, 0, calls[0][0] + r, 3) for r in range(-3, timeout + 1)]
        for at in starts:
            assert composed(at, piece.failed, piece.rows()) == looped(calls, threshold, timeout, at)


def test_runs_meet_and_their_number_is_bounded():
    rng, piece = random.Random(2), PieceFold(6, 60_000_000, False)
    for k in range(50_000):
        piece.add(k * 1000, rng.random() > 0.4)  # all within the timeout
        assert len(piece.runs) <= 6 + SUCCESSES
    for k in range(50_000):
        piece.add(60_000_000 + k * 100_000, rng.random() > 0.4)
    assert len(piece.runs) + len(piece.waiting) <= 5


def frame(spark, outcomes):
    rows = [(k, s, t, ok) for k, (s, t, ok) in enumerate(outcomes)]
    return spark.createDataFrame(rows, "id long, source string, t long, success boolean").select("id", "source", F.timestamp_seconds("t").alias("ts"), "success")


def test_one_hot_source_over_many_ranges(spark):
    rng = random.Random(9)
    calls = [("hot" if rng.random() < 0.9 else f"cold{rng.randrange(30)}", 1000 + 20 * k, rng.random() < 0.5) for k in range(3000)]
    wanted = {}
    for s, t, ok in calls:
        wanted[s] = breaker_step(wanted.get(s, FRESH), t * 1_000_000, ok, 6, 60_000_000)
    log = frame(spark, calls).repartition(7)
    got = {r.source: (r.state, r.failures, r.opened) for r in folded(log).collect()}
    assert got == {s: (v[0], v[1], v[4]) for s, v in wanted.items()}
    assert health.breaker_state(log.limit(0)).count() == 0


def test_jobs_do_not_grow_with_the_calls(spark):
    def jobs(n):
        tracker, group = spark.sparkContext.statusTracker(), f"breaker{n}"
        spark.sparkContext.setJobGroup(group, group)
        health.breaker_state(frame(spark, [("a", 30 * k, k % 3 > 0) for k in range(n)])).collect()
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(5000) <= jobs(50) + 1
