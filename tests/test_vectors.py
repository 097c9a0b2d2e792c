"""Literal vectors of the rules, worked numbers of the formulas, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from assetweave.functions import exprs
from assetweave.operators import classify, health, merge, platforms
from assetweave.operators.breaker import breaker_step

CLASSES = [
    (["stablecoin", "asset-backed-stablecoin", "usd-stablecoin"], "Tether USDt", "USDT", "tether", "Stablecoin", "USD"),
    (["stablecoin"], "USD Token", "USD-TOKEN", "usd-token", "Stablecoin", "USD"),
    (["stablecoin"], "MMK Token", "MMKtoken", "mmk-token", "Stablecoin", "MMK"),
    (["stablecoin"], "ZWD Token", "ZWDt", "zwd-token", "Stablecoin", "ZWD"),
    (["stablecoin"], "Japanese Yen Coin", "TOKEN", "japanese-yen-coin", "Stablecoin", "JPY"),
    (["stablecoin"], "NPR Digital Money", "TOKEN", "npr-digital-money", "Stablecoin", "NPR"),
    (["peggedXAU"], "Test Token", "TOKEN", "test-token", "Stablecoin", "Gold"),
    (["stablecoin"], "Advanced USD Token", "aUSDt", "advanced-usd-token", "Stablecoin", "USD"),
    (["stablecoin"], "MNEE", "MNEE", "mnee", "Stablecoin", None),
    (["stablecoin"], "Generic Stable", "GST", "generic-stable", "Stablecoin", None),
    (["tokenized-assets"], "Random Token", "RND", "random-token", "Tokenized Asset", "Tokenized Asset"),
    (["cryptocurrency", "defi"], "Cryptocurrency 1", "CRYPTO1", "crypto-1", "Other", None),
    (["stablecoin"], "Canadian Dollar Coin", "QQQQ", "q", "Stablecoin", "USD"),
]


def test_classifier_vectors(spark):
    rows = [(k, *c[:4]) for k, c in enumerate(CLASSES)]
    got = classify.classify(spark.createDataFrame(rows, "k int, tags array<string>, name string, symbol string, slug string")).orderBy("k").collect()
    assert [(r.category, r.peg_found) for r in got] == [c[4:] for c in CLASSES]


def test_classifier_takes_nulls_and_refuses_long_names(spark):
    rows = [(None, None, None, None), (["stablecoin", None], "n" * 501, "S", "s"), ([], "", "", "")]
    df = spark.createDataFrame(rows, "tags array<string>, name string, symbol string, slug string")
    assert sorted(r.category for r in classify.classify(df).collect()) == ["Other", "Other", "Stablecoin"]
    assert sorted(r.v for r in df.select(classify.input_valid().alias("v")).collect()) == [False, False, True]


@pytest.mark.parametrize(("prices", "wanted"), [([1.0], 0.5), ([1.0, 1.0, 1.02], 0.6), ([1.0, 1.2], 0.0), ([], 0.5), ([0.0, 0.0], 0.5)])
def test_consensus(spark, prices, wanted):
    got = spark.range(1).select(merge.deviation(F.array(*[F.lit(p) for p in prices]).cast("array<double>")).alias("c")).first().c
    assert got == pytest.approx(wanted)


def test_confidence(spark):
    got = spark.range(1).select(*[c.alias(n) for n, c in merge.confidence(F.lit(3), F.lit(3), F.lit(2), F.lit(0.6)).items()]).first()
    assert (got.conf_market, got.conf_supply, got.conf_overall) == pytest.approx((0.92, 1.0, 0.868))


def test_pick_goes_by_priority_then_first_seen(spark):
    rows = [("K", "cmc", 0, 10, None), ("K", "messari", 1, 8, 1.0), ("K", "coingecko", 2, 8, 0.99)]
    got = spark.createDataFrame(rows, "k string, source string, seq int, prio int, price double").groupBy("k").agg(merge.pick("price").alias("p"), merge.pick("price", True).alias("s")).first()
    assert (got.p, got.s) == (1.0, "messari")


def test_allocation(spark):
    rows = [("a", "x", 30.0, 100.0), ("a", "y", 10.0, 100.0), ("b", "x", 0.0, 100.0), ("b", "y", None, 100.0), ("c", "x", None, 100.0)]
    got = platforms.allocated(spark.createDataFrame(rows, "key string, platform string, supply double, mcap double")).collect()
    assert {(r.key, r.platform): r.alloc for r in got} == {("a", "x"): 75, ("a", "y"): 25, ("b", "x"): 0, ("b", "y"): 0, ("c", "x"): 100}


def test_cross_chain_vector(spark):
    rows = [("e", "OP Mainnet", 0, 79419.23358457036), ("e", "Ethereum", 1, 17018190.49420138), ("e", "Arbitrum", 2, 517470.7580276918), ("e", "Polygon", 3, 180050.91576013248)]
    df = spark.createDataFrame(rows, "key string, chain string, pos int, current double").withColumns({f"prev_{p}": F.lit(1.0) for p in ("day", "week", "month")})
    got = platforms.cross_chain(df).collect()
    assert {r.dominant for r in got} == {"Ethereum"}
    assert sum(r.percentage for r in got) == pytest.approx(100)
    assert "Op mainnet" in {r.chain_name for r in got}


def test_formats(spark):
    row = spark.range(1).select(exprs.fmt_compact(F.lit(1234567.0)).alias("a"), exprs.fmt_compact(F.lit(float("nan"))).alias("b"), exprs.slugify(F.lit(" A & b! ")).alias("c"), exprs.clean_numeric(F.lit(" 1.5e3x")).alias("d"), exprs.clean_numeric(F.lit("x"), 9.0).alias("e")).first()
    assert tuple(row) == ("$1.2M", "No data", "a-b", 1500.0, 9.0)


def log_frame(spark, calls):
    rows = [(k, s, t, ok) for k, (s, t, ok) in enumerate(calls)]
    return spark.createDataFrame(rows, "id long, source string, t long, success boolean").select("id", "source", F.timestamp_seconds("t").alias("ts"), "success", F.lit(5.0).alias("duration"), F.lit(1).alias("record_count"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("error_code"))


def test_breaker_fold_equals_loop_and_window(spark):
    r = random.Random(3)
    calls = [(r.choice("ab"), 1000 + 20 * k, r.random() < 0.5) for k in range(800)]
    df = log_frame(spark, calls)
    wanted, first = {}, {}
    for k, (s, t, ok) in enumerate(calls):
        before = wanted.get(s, ("closed", 0, 0, 0, 0))
        wanted[s] = breaker_step(before, t * 1_000_000, ok, 6, 60_000_000)
        if wanted[s][4] == 1 and before[4] == 0:
            first[s] = k
    got = {x.source: (x.state, x.failures, x.opened) for x in health.breaker_state(df, days=9999).collect()}
    assert got == {s: (v[0], v[1], v[4]) for s, v in wanted.items()}
    assert {x.source: x.opened_id for x in health.first_opening(df).collect()} == first


def test_breaker_opens_at_the_sixth_failure(spark):
    df = log_frame(spark, [("a", k, False) for k in range(6)])
    assert health.breaker_state(df).first().state == "open"
    assert health.breaker_state(log_frame(spark, [("a", k, False) for k in range(5)])).first().state == "closed"


def test_percentile_is_the_element_at_the_ceiling(spark):
    df = log_frame(spark, [("a", k, True) for k in range(10)]).withColumn("duration", F.col("id") + 1.0)
    assert health.latency_stats(df).first().p95 == 10.0


def test_merge_does_not_depend_on_row_order(spark):
    from assetweave.plans.assets import keyed
    from tests.oracle import DATA

    rows = keyed(spark, DATA)
    one = merge.merge_assets(rows).select("asset_key", "price", "mcap_source", "peg").collect()
    two = merge.merge_assets(rows.orderBy(F.xxhash64("key", "source"))).select("asset_key", "price", "mcap_source", "peg").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
