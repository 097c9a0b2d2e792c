"""Figures by pieces of groups: hot groups, groups of one value, names with errors."""

import random

import pytest
from pyspark.sql import functions as F

from assetweave.operators import health, ordered, views


def many(spark, n=3000):
    """One source with nearly all rows, of which two in three have one value; one row of another source."""
    r = random.Random(1)
    rows = [("hot", k, 5.0 if k % 3 else float(r.randrange(40))) for k in range(n)] + [("cold", n, 7.0)]
    return spark.createDataFrame(rows, "source string, id long, x double").repartition(5), rows


def test_pieces_split_a_hot_value(spark):
    df, rows = many(spark)
    sizes = {tuple([r.source, *r.piece]): r["count"] for r in ordered.in_pieces(df, ["source"], F.col("x"), F.col("id")).groupBy("source", "piece").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 0.1 * len(rows)


def test_running_sums_equal_plain_ones(spark):
    df, rows = many(spark)
    pieced = ordered.in_pieces(df, ["source"], F.col("x"), F.col("id"))
    got = {r.id: (r.a, r.b) for r in ordered.running(pieced, ["source"], [F.col("x"), F.col("id")], {"a": F.lit(1), "b": F.col("id")}).collect()}
    for s in ("hot", "cold"):
        total = 0
        for k, (_, i, _) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])), 1):
            total += i
            assert got[i] == (k, total)


def test_ranks_with_ties(spark):
    df, rows = many(spark)
    named = df.withColumn("name", F.concat(F.lit("k"), F.lpad("id", 5, "0")))
    got = {r.id: r["rank"] for r in views.ranked(named, F.col("x").desc(), F.col("name")).collect()}
    assert got == {i: k for k, (_, i, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])), 1)}
    assert views.ranked(named.limit(0), F.col("name")).count() == 0


def test_ranges_are_even_where_keys_have_a_long_prefix(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("double").alias("mcap"), F.concat(F.lit("https://x/"), F.lpad("id", 6, "0")).alias("key"), F.lit(1).alias("piece"), F.lit(2).alias("at"))
    by = [F.col("mcap").desc_nulls_last(), F.col("key")]
    got = ordered.numbered(rows, by, pieces=16)
    assert got.columns == ["mcap", "key", "piece", "at", "rank"]
    assert got.where("rank <> cast(right(key, 6) AS int) + 1").count() == 0
    sizes = [r["count"] for r in rows.repartitionByRange(16, *by).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 20_000 / 16


def test_large_caps_keep_their_blocks(spark):
    r = random.Random(4)
    rows = [(k, "Stablecoin" if k % 3 else "Other", r.choice([None, float("inf"), r.uniform(-1e300, 1e300), 4e19 * r.random(), 5.0])) for k in range(2000)]
    df = spark.createDataFrame(rows, "key long, category string, mcap double").repartition(5)
    got = {x.key: x["rank"] for x in views.ranked(df, F.when(F.col("category") == "Stablecoin", 0).otherwise(1), F.col("mcap").desc_nulls_last(), F.col("key")).collect()}
    wanted = sorted(rows, key=lambda x: (x[1] != "Stablecoin", x[2] is None, -(x[2] or 0), x[0]))
    assert got == {x[0]: k for k, x in enumerate(wanted, 1)}


def test_pieces_take_free_names(spark):
    df, rows = many(spark)
    odd = df.withColumns({n: F.lit(7) for n in ("first", "second", "place", "cuts", "_first")})
    got = ordered.in_pieces(odd, ["source"], F.col("x"), F.col("id"))
    assert got.columns == [*odd.columns, "piece"] and got.where("first + second + place + cuts + _first <> 35").count() == 0 and got.count() == len(rows)


@pytest.mark.parametrize("small", [10_000, 0])
def test_values_at_places(spark, monkeypatch, small):
    monkeypatch.setattr(ordered, "SMALL", small)
    df, rows = many(spark)
    got = {r.source: tuple(r)[1:] for r in ordered.values_at(df, ["source"], "x", {"first": F.lit(0), "mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1}).collect()}
    for s in ("hot", "cold"):
        own = sorted(x for t, _, x in rows if t == s)
        assert got[s] == (own[0], own[len(own) // 2], own[-1])


def calls(spark, outcomes, step=20):
    rows = [(k, s, 1000 + step * k, ok) for k, (s, ok) in enumerate(outcomes)]
    return spark.createDataFrame(rows, "id long, source string, t long, success boolean").select("id", "source", F.timestamp_seconds("t").alias("ts"), "success")


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_first_opening_over_pieces(spark, share):
    r = random.Random(11)
    outcomes = [("hot", r.random() < share) for _ in range(500)]
    got = {x.source: x.opened_id for x in health.first_opening(calls(spark, outcomes), 4).collect()}
    count, wanted = 0, {}
    for k, (s, ok) in enumerate(outcomes):
        count = max(0, count - 1) if ok else count + 1
        if count >= 4 and not ok:
            wanted.setdefault(s, k)
    assert got == wanted


def test_what_is_stored_can_be_cleared(spark):
    import os

    df = ordered.stored(spark.range(3), "three")
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert df.count() == 3 and os.path.isdir(folder)
    assert ordered.clear_stored(spark) >= 1 and not os.path.exists(folder) and ordered.clear_stored(spark) == 0
