"""Queries on snapshots: raw payloads made from the tables, read by the scans' schemas and standardized.

The scans read files; here the payload of each source is written as JSON to a folder first, so that a query covers
scan, projection and all. The folder is in spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.operators import standardize as st
from assetweave.operators.ordered import shared_path as folder, stored
from assetweave.plans.bindings import SRC_ASSET, asset_platform, src_asset, with_
from assetweave.registry import query
from assetweave.sources import snapshots as sn
from assetweave.sources.versions import newest


def landed(spark: SparkSession, name: str, rows: DataFrame) -> str:
    """rows (payload) as one JSON document a file."""
    path = folder(spark, name)
    rows.select("payload").write.option("maxRecordsPerFile", 1).text(path)
    return path


def of(spark: SparkSession, d: str, seq: int) -> DataFrame:
    return src_asset(spark, d).where(F.col("seq") == seq)


def _wrapped(rows: DataFrame, item, field: str | None) -> DataFrame:
    """Documents of the items of each thousandth key range; a document is bounded by that range."""
    docs = rows.groupBy(F.floor(F.col("key") / 1000).alias("g")).agg(F.collect_list(item).alias("x"))
    return docs.select((F.to_json(F.struct(F.col("x").alias(field))) if field else F.to_json("x")).alias("payload"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    usd = F.struct(F.col("price"), F.col("mcap").alias("market_cap"), F.col("volume").alias("volume_24h"), F.col("change").alias("percent_change_24h"))
    item = F.struct(F.col("key").alias("id"), "name", "symbol", F.col("slug"), "tags", F.col("rank").alias("cmc_rank"), "date_added", F.col("circulating").alias("circulating_supply"), F.when(F.col("key") % 2 == 0, F.struct(F.when(F.col("key") % 6 != 0, "Ethereum").alias("name"), F.when(F.col("key") % 8 == 0, "").when(F.col("key") % 10 != 0, "ethereum").alias("slug"), F.when(F.col("key") % 14 != 0, "ETH").alias("symbol"), F.concat(F.lit("0x"), "key").alias("token_address"))).alias("platform"), F.struct(usd.alias("USD")).alias("quote"))
    return sn.scan_listings(spark, landed(spark, "listings", _wrapped(of(spark, d, 0), item, "data")))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    link = lambda network, name, amount: F.struct(network.cast("string").alias("network"), name.cast("string").alias("name"), amount.cast("double").alias("amount"))
    links = F.array(link(F.lit("tron"), F.lit(None), F.col("volume")), link(F.lit(None), F.lit(""), F.lit(1.0)))
    item = F.struct(F.col("key").cast("string").alias("id"), "name", "symbol", "slug", "tags", F.struct(F.col("circulating"), F.col("total")).alias("supply"), F.when(F.col("key") % 2 == 0, links).alias("networks"), F.when(F.col("key") % 2 == 1, F.create_map(F.lit("a"), F.get(links, F.lit(0)))).alias("chains"))
    rows = of(spark, d, 1).select(item.alias("i"), "key")
    return sn.scan_supply_metrics(spark, landed(spark, "metrics", _wrapped(rows, F.col("i"), "data")))


def pegged(spark: SparkSession, d: str) -> DataFrame:
    plats = asset_platform(spark, d).where("supply > 0").groupBy(F.col("key").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("platform", F.struct(F.create_map(F.lit("peggedUSD"), F.col("supply")).alias("current"))))).alias("chainCirculating"))
    rows = of(spark, d, 3).join(plats, F.col("key") == F.col("k"), "left")
    code = F.when(F.col("peg") == "Gold", "XAU").otherwise(F.upper("peg"))
    peg = F.concat(F.lit("pegged"), code)
    item = F.struct(F.col("key").cast("string").alias("id"), "name", F.coalesce("symbol", F.lit("none")).alias("symbol"), peg.alias("pegType"), F.lit("fiat-backed").alias("pegMechanism"), "price", F.create_map(peg, F.col("circulating")).alias("circulating"), "chainCirculating")
    return sn.scan_chain_supply(spark, landed(spark, "pegged", _wrapped(rows.select(item.alias("i"), "key"), F.col("i"), "peggedAssets")))


def markets(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.concat(F.lit("ID"), "key").alias("id"), "symbol", "name", F.col("price").alias("current_price"), F.col("mcap").alias("market_cap"), F.col("volume").alias("total_volume"), F.col("change").alias("price_change_percentage_24h"))
    return sn.scan_markets(spark, landed(spark, "markets", _wrapped(of(spark, d, 2), item, None)))


@query("scan_listings", with_(SRC_ASSET, body="SELECT key AS id, name, symbol, rank AS cmc_rank, round(price, 6) AS price, len(tags) AS n_tags FROM src_asset WHERE seq = 0"))
def scan_listings(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).select("id", "name", "symbol", "cmc_rank", F.round("quote.USD.price", 6).alias("price"), F.size("tags").alias("n_tags"))


@query("scan_supply_metrics", with_(SRC_ASSET, body="SELECT key::VARCHAR AS id, name, circulating, CASE WHEN key % 2 = 0 THEN 2 ELSE 1 END AS n_links FROM src_asset WHERE seq = 1"))
def scan_supply_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select("id", "name", F.col("supply.circulating").alias("circulating"), F.size("breakdown").alias("n_links"))


@query("scan_chain_supply", with_(SRC_ASSET, body="SELECT key::VARCHAR AS id, name, round(price, 6) AS price, 'pegged' || CASE WHEN peg = 'Gold' THEN 'XAU' ELSE upper(peg) END AS peg_type FROM src_asset WHERE seq = 3"))
def scan_chain_supply(spark: SparkSession, d: str) -> DataFrame:
    return pegged(spark, d).select("id", "name", F.round("price", 6).alias("price"), F.col("pegType").alias("peg_type"))


@query("scan_markets", with_(SRC_ASSET, body="SELECT 'ID' || key AS id, symbol, mcap AS market_cap, volume AS total_volume FROM src_asset WHERE seq = 2"))
def scan_markets(spark: SparkSession, d: str) -> DataFrame:
    return markets(spark, d).select("id", "symbol", "market_cap", "total_volume")


@query("scan_distinct_pegs", with_(SRC_ASSET, body="SELECT DISTINCT 'pegged' || CASE WHEN peg = 'Gold' THEN 'XAU' ELSE upper(peg) END AS peg_type FROM src_asset WHERE seq = 3 ORDER BY 1"))
def scan_distinct_pegs(spark: SparkSession, d: str) -> DataFrame:
    return sn.scan_distinct_pegs(pegged(spark, d))


@query("std_listings", with_(SRC_ASSET, body="""SELECT key::VARCHAR AS id, upper(symbol) AS symbol, lower(coalesce(nullif(slug, ''), symbol)) AS slug, round(coalesce(nullif(mcap, 0) / nullif(price, 0), circulating), 6) AS circulating,
  (key % 2 = 0)::INT AS n_networks, CASE WHEN key % 2 = 0 THEN CASE WHEN key % 6 <> 0 THEN 'Ethereum' ELSE 'Unknown' END END AS network_name, CASE WHEN key % 2 = 0 THEN CASE WHEN key % 8 <> 0 AND key % 10 <> 0 THEN 'ethereum' WHEN key % 14 <> 0 THEN 'eth' END END AS network, 'https://s2.coinmarketcap.com/static/img/coins/64x64/' || key || '.png' AS logo, 0.9::DOUBLE AS confidence FROM src_asset WHERE seq = 0"""))
def std_listings(spark: SparkSession, d: str) -> DataFrame:
    return st.std_listings(listings(spark, d)).select("id", "symbol", "slug", F.round("circulating", 6).alias("circulating"), F.size("networks").alias("n_networks"), F.get("networks", F.lit(0))["name"].alias("network_name"), F.get("networks", F.lit(0))["network"].alias("network"), "logo", "confidence")


@query("std_supply_metrics", with_(SRC_ASSET, body="SELECT key::VARCHAR AS id, upper(symbol) AS symbol, 1.0::DOUBLE AS price, circulating AS mcap, total, 1 AS n_networks, volume AS first_supply FROM src_asset WHERE seq = 1"))
def std_supply_metrics(spark: SparkSession, d: str) -> DataFrame:
    return st.std_supply_metrics(metrics(spark, d)).select("id", "symbol", "price", "mcap", "total", F.size("networks").alias("n_networks"), F.get("networks", F.lit(0))["supply"].alias("first_supply"))


@query("std_chain_supply", with_(SRC_ASSET, body="""
, plats AS (SELECT l_partkey AS k, count(*) AS n, sum(q) AS supply FROM (SELECT l_partkey, n_nationkey, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_partkey % 9 <> 0 GROUP BY 1, 2) WHERE q > 0 GROUP BY 1)
SELECT key::VARCHAR AS id, replace(lower(name), ' ', '-') AS slug, round(circulating * price, 4) AS mcap, coalesce(n, 0) AS n_networks, round(coalesce(supply, 0) / circulating * 100, 4) AS percentage, 3 AS n_tags FROM src_asset LEFT JOIN plats ON k = key WHERE seq = 3"""))
def std_chain_supply(spark: SparkSession, d: str) -> DataFrame:
    rows = st.std_chain_supply(pegged(spark, d))
    whole = F.aggregate("networks", F.lit(0.0), lambda a, x: a + x["percentage"])
    return rows.select("id", "slug", F.round("mcap", 4).alias("mcap"), F.size("networks").alias("n_networks"), F.round(whole, 4).alias("percentage"), F.size("tags").alias("n_tags"))


@query("std_markets", with_(SRC_ASSET, body="SELECT 'ID' || key AS id, upper(symbol) AS symbol, 'id' || key AS slug, round(price, 6) AS price, mcap, volume, 'coingecko' AS tags, 0.6::DOUBLE AS confidence FROM src_asset WHERE seq = 2"))
def std_markets(spark: SparkSession, d: str) -> DataFrame:
    return st.std_markets(markets(spark, d)).select("id", "symbol", "slug", F.round("price", 6).alias("price"), "mcap", "volume", F.array_join("tags", ",").alias("tags"), "confidence")


@query("adapt_for_view", with_(SRC_ASSET, body="""
SELECT id, round(coalesce(nullif(mcap, 0), circulating * price), 4) AS mcap, tags, CASE WHEN regexp_matches(id, '^[0-9]+$') THEN 'https://s2.coinmarketcap.com/static/img/coins/64x64/' || id || '.png' END AS image
FROM (SELECT CASE WHEN key % 2 = 0 THEN key::VARCHAR ELSE 'x' || key END AS id, CASE WHEN key % 5 = 0 THEN 0 ELSE mcap END AS mcap, circulating, price, CASE WHEN key % 3 = 0 THEN 'stablecoin' ELSE array_to_string(tags, ',') END AS tags FROM src_asset WHERE seq = 0)"""))
def adapt_for_view(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("key")
    rows = of(spark, d, 0).select(F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("x"), k)).alias("id"), F.when(k % 5 != 0, F.col("mcap")).otherwise(0.0).alias("mcap"), "circulating", "price", F.when(k % 3 != 0, F.col("tags")).alias("tags"), F.lit("").alias("logo"))
    return st.adapt_for_view(rows).select("id", F.round("mcap", 4).alias("mcap"), F.array_join("tags", ",").alias("tags"), "image")


@query("sink_snapshot", with_(SRC_ASSET, body="SELECT source, count(*) AS n, count(*) FILTER (WHERE price >= 950) AS eligible FROM src_asset GROUP BY source"))
def sink_snapshot(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "bronze")
    rows = src_asset(spark, d).withColumn("snapshot_ts", F.lit("2024-01-01T00"))
    sn.sink_snapshot(rows, path, F.col("price") >= 950)
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") >= 950).alias("eligible"))


@query("sink_gold_by_platform", """
WITH rows AS (SELECT DISTINCT l_partkey AS key, n_name AS platform FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT 'platform' AS output, platform AS folder, NULL AS prefix, count(*) AS n FROM rows GROUP BY platform
UNION ALL SELECT 'asset', key::VARCHAR, md5(key::VARCHAR)[1:2], count(*) FROM rows GROUP BY key""")
def sink_gold_by_platform(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the folders of each platform and of each asset."""
    rows, path = stored(asset_platform(spark, d), "gold_rows"), folder(spark, "gold")
    sn.sink_gold(rows, f"{path}/platforms", "platform")
    sn.sink_gold_by_asset(rows.withColumn("asset", F.col("key").cast("string")), f"{path}/assets", "asset")
    platforms, assets = newest(spark, f"{path}/platforms"), sn.gold_by_asset(spark, f"{path}/assets", "asset", rows.schema)
    of = lambda df, output, by, prefix: df.groupBy(F.lit(output).alias("output"), F.col(by).cast("string").alias("folder"), prefix.cast("string").alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return of(platforms, "platform", "platform", F.lit(None)).unionByName(of(assets, "asset", "asset", F.col("prefix")))
