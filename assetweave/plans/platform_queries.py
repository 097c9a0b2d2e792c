"""Queries on platforms and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.functions.exprs import percent, slugify
from assetweave.operators import merge, platforms
from assetweave.operators.views import platform_rank_text, ranked, share_of_asset, top, top_and_others, top_per_group
from assetweave.plans.assets import ALL, merged
from assetweave.plans.bindings import ASSET_PLATFORM, CHAIN_HISTORY, asset_platform, chain_history, table, with_
from assetweave.registry import query

CAPS = """
caps AS (SELECT l_partkey AS key, round(sum(l_extendedprice), 2) AS mcap FROM lineitem GROUP BY 1),
rows AS (SELECT key, 'A' || key AS symbol, platform, pos, supply, mcap FROM asset_platform JOIN caps USING (key)),
alloc AS (SELECT *, CASE WHEN sum(supply) OVER w > 0 AND supply > 0 THEN mcap * (supply / sum(supply) OVER w) WHEN count(*) OVER w = 1 THEN mcap ELSE 0 END AS alloc FROM rows WINDOW w AS (PARTITION BY key)),
roll0 AS (SELECT platform, sum(alloc) AS mcap_sum, count(*) AS coin_count, sum(supply) AS total_supply FROM alloc GROUP BY 1),
roll AS (SELECT platform, lower(replace(platform, '_', '-')) AS uri, mcap_sum, coin_count, total_supply, floor(total_supply / sum(total_supply) OVER () * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS supply_percentage FROM roll0),
broken AS (SELECT platform, symbol, sum(supply) AS supply, min(key) AS first FROM alloc WHERE supply > 0 GROUP BY 1, 2)"""
P = (ASSET_PLATFORM, CAPS)


def allocated(spark: SparkSession, d: str) -> DataFrame:
    caps = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.round(F.sum("l_extendedprice"), 2).alias("mcap"))
    rows = asset_platform(spark, d).join(caps, "key").withColumn("symbol", F.concat(F.lit("A"), "key"))
    return platforms.allocated(rows)


@query("mcap_allocation", with_(*P, body="SELECT key, platform, round(alloc, 6) AS alloc FROM alloc"))
def mcap_allocation(spark: SparkSession, d: str) -> DataFrame:
    return allocated(spark, d).select("key", "platform", F.round("alloc", 6).alias("alloc"))


@query("platform_rollup", with_(*P, body="SELECT platform, uri, round(mcap_sum, 2) AS mcap_sum, coin_count, round(total_supply, 2) AS total_supply, round(supply_percentage, 2) AS supply_percentage FROM roll"))
def platform_rollup(spark: SparkSession, d: str) -> DataFrame:
    return platforms.rollup(allocated(spark, d)).select("platform", "uri", F.round("mcap_sum", 2).alias("mcap_sum"), "coin_count", F.round("total_supply", 2).alias("total_supply"), F.round("supply_percentage", 2).alias("supply_percentage"))


@query("platform_supply_breakdown", with_(*P, body="SELECT platform, symbol, round(supply, 2) AS supply, round(floor(supply / sum(supply) OVER (PARTITION BY platform) * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE, 2) AS percentage FROM broken"))
def platform_supply_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return platforms.breakdown(allocated(spark, d)).select("platform", "symbol", F.round("supply", 2).alias("supply"), F.round("percentage", 2).alias("percentage"))


@query("platform_dominant_asset", with_(*P, body="SELECT platform, symbol, round(supply, 2) AS supply FROM broken QUALIFY row_number() OVER (PARTITION BY platform ORDER BY supply DESC, first) = 1"))
def platform_dominant_asset(spark: SparkSession, d: str) -> DataFrame:
    return platforms.dominant(allocated(spark, d)).select("platform", "symbol", F.round("supply", 2).alias("supply"))


@query("platform_members", with_(*P, body="SELECT platform, symbol, mcap, round(supply, 2) AS supply FROM alloc QUALIFY row_number() OVER (PARTITION BY platform, symbol ORDER BY key) = 1"))
def platform_members(spark: SparkSession, d: str) -> DataFrame:
    return platforms.members(allocated(spark, d)).select("platform", "symbol", "mcap", F.round("supply", 2).alias("supply"))


@query("platform_mcap_lookup", with_(*P, body="SELECT round(coalesce(sum(mcap_sum) FILTER (WHERE platform = 'NATION_3'), 0), 2) AS mcap FROM roll"))
def platform_mcap_lookup(spark: SparkSession, d: str) -> DataFrame:
    return platforms.rollup(allocated(spark, d)).agg(F.round(F.coalesce(F.sum(F.when(F.col("platform") == "NATION_3", F.col("mcap_sum"))), F.lit(0.0)), 2).alias("mcap"))


@query("chain_data_completeness", with_(*P, body="SELECT floor(avg(ok) * 100 + 0.5) AS completeness, avg(ok) > 0.75 AS show FROM (SELECT key, max((supply > 0)::INT)::DOUBLE AS ok FROM alloc GROUP BY key)"))
def chain_data_completeness(spark: SparkSession, d: str) -> DataFrame:
    each = allocated(spark, d).groupBy("key").agg(F.max(F.when(F.col("supply") > 0, 1.0).otherwise(0.0)).alias("ok"))
    return each.agg(F.floor(F.avg("ok") * 100 + 0.5).cast("double").alias("completeness"), (F.avg("ok") > 0.75).alias("show"))


@query("rank_platforms", with_(*P, body="""SELECT platform, round(total_supply, 2) AS total_supply, rank, '#' || rank || CASE WHEN rank = 1 THEN ' (Leading by supply)' WHEN rank <= 3 THEN ' (Top 3 by supply)' WHEN rank <= 5 THEN ' (Top 5 by supply)' WHEN rank <= 10 THEN ' (Top 10 by supply)' ELSE ' by supply' END AS band
FROM (SELECT *, row_number() OVER (ORDER BY round(total_supply, 2) DESC, platform) AS rank FROM roll)"""))
def rank_platforms(spark: SparkSession, d: str) -> DataFrame:
    rows = platforms.rollup(allocated(spark, d)).select("platform", F.round("total_supply", 2).alias("total_supply"))
    return ranked(rows, F.col("total_supply").desc(), F.col("platform")).withColumn("band", platform_rank_text(F.col("rank")))


@query("platforms_by_mcap", with_(*P, body="SELECT platform, round(mcap_sum, 2) AS mcap_sum FROM roll ORDER BY mcap_sum DESC"))
def platforms_by_mcap(spark: SparkSession, d: str) -> DataFrame:
    return platforms.rollup(allocated(spark, d)).select("platform", F.round("mcap_sum", 2).alias("mcap_sum")).orderBy(F.col("mcap_sum").desc())


@query("top_platforms", with_(*P, body="""SELECT r.platform, round(total_supply, 2) AS total_supply, d.symbol FROM (SELECT * FROM roll ORDER BY round(total_supply, 2) DESC, platform LIMIT 3) r
JOIN (SELECT platform, symbol FROM broken QUALIFY row_number() OVER (PARTITION BY platform ORDER BY supply DESC, first) = 1) d USING (platform)"""))
def top_platforms(spark: SparkSession, d: str) -> DataFrame:
    rows = allocated(spark, d)
    best = top(platforms.rollup(rows).select("platform", F.round("total_supply", 2).alias("total_supply")), 3, F.col("total_supply").desc(), F.col("platform"))
    return best.join(platforms.dominant(rows).select("platform", "symbol"), "platform")


@query("top_breakdown", with_(*P, body="""SELECT platform, symbol, round(supply, 2) AS supply, place, greatest(0, n - 3) AS more FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY supply DESC, first) AS place, count(*) OVER (PARTITION BY platform) AS n FROM broken) WHERE place <= 3"""))
def top_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return top_per_group(platforms.breakdown(allocated(spark, d)), "platform", 3, F.col("supply").desc(), F.col("first")).select("platform", "symbol", F.round("supply", 2).alias("supply"), "place", "more")


@query("top_platforms_others", with_(*P, body="""
, best AS (SELECT platform AS label, total_supply AS value FROM roll ORDER BY round(total_supply, 2) DESC, platform LIMIT 8), whole AS (SELECT sum(total_supply) AS w FROM roll)
SELECT label, round(value / w * 100, 4) AS share FROM best, whole UNION ALL SELECT 'Others', round((w - t) / w * 100, 4) FROM whole, (SELECT sum(value) AS t FROM best) WHERE w > t + 1e-9"""))
def top_platforms_others(spark: SparkSession, d: str) -> DataFrame:
    rows = platforms.rollup(allocated(spark, d)).withColumn("total_supply", F.round("total_supply", 2))
    return top_and_others(rows, "platform", "total_supply", 8).select("label", F.round("share", 4).alias("share"))


@query("lookup_platform", with_(*P, body="SELECT platform, uri, round(total_supply, 2) AS total_supply FROM roll WHERE uri = 'nation-7'"))
def lookup_platform(spark: SparkSession, d: str) -> DataFrame:
    rows = platforms.rollup(allocated(spark, d))
    hit = F.when(F.col("uri") == "nation-7", 0).when(slugify("platform") == "nation-7", 1)
    return rows.withColumn("hit", hit).where("hit IS NOT NULL").orderBy("hit", "platform").limit(1).select("platform", "uri", F.round("total_supply", 2).alias("total_supply"))


@query("assets_on_platform", with_(ASSET_PLATFORM, *ALL, body="SELECT asset_key, name FROM merged WHERE asset_key IN (SELECT 'A' || key FROM asset_platform WHERE platform = 'NATION_7')"))
def assets_on_platform(spark: SparkSession, d: str) -> DataFrame:
    on = asset_platform(spark, d).where(F.col("platform") == "NATION_7").select(F.concat(F.lit("A"), "key").alias("asset_key"))
    return merged(spark, d).join(on, "asset_key", "left_semi").select("asset_key", "name")


@query("platform_share_of_asset", with_(ASSET_PLATFORM, *ALL, body="""
SELECT 'A' || p.key AS asset_key, platform, CASE WHEN p.supply >= 0 AND circulating > 0 THEN round(floor(p.supply / circulating * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE, 2) END AS share,
  CASE WHEN NOT coalesce(p.supply >= 0 AND circulating > 0, false) THEN 'missing' WHEN p.supply > circulating THEN 'inconsistent' ELSE 'ok' END AS status
FROM asset_platform p JOIN merged ON merged.asset_key = 'A' || p.key"""))
def platform_share_of_asset(spark: SparkSession, d: str) -> DataFrame:
    rows = asset_platform(spark, d).withColumn("asset_key", F.concat(F.lit("A"), "key")).join(merged(spark, d).select("asset_key", "circulating"), "asset_key")
    share, status = share_of_asset(F.col("supply"), F.col("circulating"))
    return rows.select("asset_key", "platform", F.round(share, 2).alias("share"), status.alias("status"))


@query("chain_breakdown", with_(CHAIN_HISTORY, *ALL, body="""
SELECT asset_key, string_agg(chain || ':' || current::BIGINT || ':' || floor(current / circulating * 10000 + 0.5)::BIGINT, ' ' ORDER BY current DESC, pos) AS chains
FROM chain_history JOIN merged ON asset_key = 'A' || key WHERE current > 0 AND circulating > 0 GROUP BY asset_key"""))
def chain_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = chain_history(spark, d).where("current > 0").withColumn("asset_key", F.concat(F.lit("A"), "key")).join(merged(spark, d).where("circulating > 0").select("asset_key", "circulating"), "asset_key")
    item = F.concat_ws(":", "chain", F.col("current").cast("long"), F.floor(F.col("current") / F.col("circulating") * 10000 + 0.5))
    got = rows.groupBy("asset_key").agg(F.array_sort(F.collect_list(F.struct((-F.col("current")).alias("c"), "pos", item.alias("item")))).alias("x"))
    return got.select("asset_key", F.array_join(F.transform("x", lambda e: e["item"]), " ").alias("chains"))


CHAIN_NAMES = """
chains AS (SELECT key, pos, CASE WHEN pos = 1 THEN 'Ethereum' WHEN pos = 2 THEN 'ethereum classic' WHEN pos = 3 THEN 'OP Mainnet' ELSE chain END AS chain, current, prev_day, prev_week, prev_month FROM chain_history),
named AS (SELECT *, CASE WHEN pos IN (1, 2) THEN 'Ethereum' WHEN pos = 3 THEN 'Op mainnet' ELSE upper(chain[1]) || lower(chain[2:]) END AS chain_name FROM chains WHERE current > 0)"""


def chains(spark: SparkSession, d: str) -> DataFrame:
    return chain_history(spark, d).withColumn("chain", F.when(F.col("pos") == 1, "Ethereum").when(F.col("pos") == 2, "ethereum classic").when(F.col("pos") == 3, "OP Mainnet").otherwise(F.col("chain")))


@query("cross_chain_summary", with_(CHAIN_HISTORY, CHAIN_NAMES, body="""
SELECT n.key, n.chain_name, n.current, n.prev_day, n.prev_week, n.prev_month, round(w.total, 2) AS total, w.dominant, round(n.current / w.total * 100, 6) AS percentage
FROM (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY key, chain_name ORDER BY pos DESC) = 1) n
JOIN (SELECT key, sum(current) AS total, arg_max(chain_name, current * 1000 - pos) AS dominant FROM named GROUP BY key) w USING (key)"""))
def cross_chain_summary(spark: SparkSession, d: str) -> DataFrame:
    return platforms.cross_chain(chains(spark, d)).select("key", "chain_name", "current", "prev_day", "prev_week", "prev_month", F.round("total", 2).alias("total"), "dominant", F.round("percentage", 6).alias("percentage"))


@query("supply_change", with_(CHAIN_HISTORY, body="""
SELECT key, chain, round(current - prev_day, 2) AS change_day, round(current - prev_week, 2) AS change_week, round(current - prev_month, 2) AS change_month,
  round((current - prev_day) * 100 / nullif(prev_day, 0), 6) AS pct_day, round((current - prev_week) * 100 / nullif(prev_week, 0), 6) AS pct_week, round((current - prev_month) * 100 / nullif(prev_month, 0), 6) AS pct_month FROM chain_history"""))
def supply_change(spark: SparkSession, d: str) -> DataFrame:
    rows = platforms.supply_change(chain_history(spark, d))
    return rows.select("key", "chain", *[F.round(f"change_{p}", 2).alias(f"change_{p}") for p in ("day", "week", "month")], *[F.round(f"pct_{p}", 6).alias(f"pct_{p}") for p in ("day", "week", "month")])


@query("chain_long", with_(CHAIN_HISTORY, body="SELECT key::VARCHAR AS id, chain, current, prev_day, prev_week, prev_month FROM chain_history"))
def chain_long(spark: SparkSession, d: str) -> DataFrame:
    peg = lambda c: F.create_map(F.when(F.col("key") % 2 == 0, "peggedUSD").otherwise("peggedXAU"), F.col(c))
    entry = F.struct("chain", F.struct(peg("current").alias("current"), peg("prev_day").alias("circulatingPrevDay"), peg("prev_week").alias("circulatingPrevWeek"), peg("prev_month").alias("circulatingPrevMonth")))
    nested = chain_history(spark, d).groupBy(F.col("key").cast("string").alias("id")).agg(F.map_from_entries(F.collect_list(entry)).alias("chainCirculating"))
    return platforms.chain_long(nested).select("id", "chain", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("current", "prev_day", "prev_week", "prev_month")])


RAW_NAMES = ["ethereum", " TRX ", "binance-smart-chain", "Polygon PoS", "avalanche c-chain", "OP Mainnet", "zkSync", "Base", "moonBeam", "", "terra classic", "BTC lightning"]
RAW_SQL = "raw AS (SELECT p_partkey AS key, ([" + ", ".join(f"'{n}'" for n in RAW_NAMES) + "])[(p_partkey % 13)::INT + 1] AS raw FROM part)"


def raw_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.get(F.array(*[F.lit(n) for n in RAW_NAMES]), (F.col("p_partkey") % 13).cast("int")).alias("raw"))


def _sql_names(aliases: dict[str, str], contains: list[tuple[str, str]]) -> str:
    low = "regexp_replace(lower(raw), '^\\s+|\\s+$', '', 'g')"
    return "CASE WHEN raw IS NULL OR raw = '' THEN 'Unknown' " + "".join(f"WHEN {low} = '{k}' THEN '{v}' " for k, v in aliases.items()) + "".join(f"WHEN contains({low}, '{p}') THEN '{v}' " for p, v in contains) + "ELSE upper(raw[1]) || lower(raw[2:]) END"


from assetweave.functions import taxonomy as tx  # noqa: E402


@query("platform_name_normalize", with_(RAW_SQL, body=f"SELECT key, {_sql_names(tx.PLATFORM_ALIASES, tx.PLATFORM_CONTAINS)} AS name FROM raw"))
def platform_name_normalize(spark: SparkSession, d: str) -> DataFrame:
    return raw_names(spark, d).select("key", platforms.platform_name("raw").alias("name"))


@query("platform_name_normalize_v2", with_(RAW_SQL, body=f"SELECT key, {_sql_names({k: tx.PLATFORM_ALIASES[k] for k in platforms.V2}, [])} AS name FROM raw"))
def platform_name_normalize_v2(spark: SparkSession, d: str) -> DataFrame:
    return raw_names(spark, d).select("key", platforms.platform_name_v2("raw").alias("name"))


@query("platform_name_normalize_v3", with_(RAW_SQL, body=f"SELECT key, {_sql_names({k: tx.PLATFORM_ALIASES[k] for k in platforms.V3}, platforms.V3_CONTAINS)} AS name FROM raw"))
def platform_name_normalize_v3(spark: SparkSession, d: str) -> DataFrame:
    return raw_names(spark, d).select("key", platforms.platform_name_v3("raw").alias("name"))


@query("platform_known", with_(RAW_SQL, body=f"SELECT known, count(*) AS n FROM (SELECT {_sql_names(tx.PLATFORM_ALIASES, tx.PLATFORM_CONTAINS)} IN ({', '.join(repr(v) for v in sorted(set(tx.PLATFORM_ALIASES.values())))}) AS known FROM raw) GROUP BY known"))
def platform_known(spark: SparkSession, d: str) -> DataFrame:
    return raw_names(spark, d).groupBy(platforms.platform_known("raw").alias("known")).agg(F.count(F.lit(1)).alias("n"))


TIERS = """
tiers AS (SELECT key, 1 AS tier, pos, chain AS name FROM chain_history WHERE key % 3 = 0
  UNION ALL SELECT key, 2, pos::INT, CASE WHEN pos % 2 = 0 THEN 'Ethereum' WHEN pos % 5 = 0 THEN 'ethereum' ELSE platform END FROM asset_platform WHERE key % 3 < 2
  UNION ALL SELECT p_partkey, 3, 0, 'Tron network' FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, 5, 0, 'Unknown' FROM part),
norm AS (SELECT *, CASE WHEN contains(lower(name), 'ethereum') THEN 'Ethereum' WHEN contains(lower(name), 'tron') THEN 'Tron' ELSE upper(name[1]) || lower(name[2:]) END AS platform FROM tiers QUALIFY tier = min(tier) OVER (PARTITION BY key))"""


@query("extract_platforms", with_(ASSET_PLATFORM, CHAIN_HISTORY, TIERS, body="SELECT key, tier, platform, pos FROM norm QUALIFY row_number() OVER (PARTITION BY key, platform ORDER BY pos) = 1"))
def extract_platforms(spark: SparkSession, d: str) -> DataFrame:
    one = chain_history(spark, d).where("key % 3 = 0").select("key", F.lit(1).alias("tier"), "pos", F.col("chain").alias("name"))
    two = asset_platform(spark, d).where("key % 3 < 2").select("key", F.lit(2).alias("tier"), F.col("pos").cast("int").alias("pos"), F.when(F.col("pos") % 2 == 0, "Ethereum").when(F.col("pos") % 5 == 0, "ethereum").otherwise(F.col("platform")).alias("name"))
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "key")
    three = part.where("key % 5 = 0").select("key", F.lit(3).alias("tier"), F.lit(0).alias("pos"), F.lit("Tron network").alias("name"))
    last = part.select("key", F.lit(5).alias("tier"), F.lit(0).alias("pos"), F.lit("Unknown").alias("name"))
    return platforms.extract_platforms(one.union(two).union(three).union(last))
