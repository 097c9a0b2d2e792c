"""Queries of viewers: filters, lookups, ranks, sorts, shares and display texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.functions import exprs
from assetweave.functions import taxonomy as tx
from assetweave.operators import filters as fl
from assetweave.operators import merge, views
from assetweave.operators.standardize import view_row_valid
from assetweave.plans.assets import ALL, ASSETS, CONFLICTS, keyed, merged
from assetweave.plans.bindings import ASSET_PLATFORM, asset_platform, table, with_
from assetweave.registry import query

VIEW = """
plats AS (SELECT 'A' || key AS asset_key, list(platform) AS platforms FROM asset_platform GROUP BY 1),
vw AS (SELECT m.*, coalesce(len(platforms), 0) AS n_platforms, coalesce(platforms, []) AS platforms, asset_key IN (SELECT asset_key FROM conflicts) AS conflicted FROM merged m LEFT JOIN plats USING (asset_key))"""
V = (*ALL, CONFLICTS, ASSET_PLATFORM, VIEW)


def view(spark: SparkSession, d: str) -> DataFrame:
    plats = asset_platform(spark, d).groupBy(F.concat(F.lit("A"), "key").alias("asset_key")).agg(F.collect_list("platform").alias("platforms"))
    bad = merge.field_conflicts(keyed(spark, d), ["peg", "category", "website"]).select("asset_key").distinct().withColumn("conflicted", F.lit(True))
    rows = merged(spark, d).join(plats, "asset_key", "left").join(bad, "asset_key", "left")
    return rows.withColumns({"platforms": F.coalesce("platforms", F.array().cast("array<string>")), "n_platforms": F.coalesce(F.size("platforms"), F.lit(0)), "conflicted": F.coalesce("conflicted", F.lit(False))})


def kept(spark: SparkSession, d: str, **choice) -> DataFrame:
    return fl.Filters(**choice).apply(view(spark, d)).select("asset_key")


_CLASS = "CASE " + " ".join(f"WHEN lower(coalesce(peg, '')) IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in fl.PEG_CLASSES.items()) + " ELSE 'other' END"
_W = {
    "type": f"{_CLASS} IN ('fiat', 'other')",
    "price": "coalesce(price, 0) BETWEEN 900 AND 980",
    "mcap": "coalesce(mcap, 0) / 1000000.0::DOUBLE BETWEEN 0.2 AND 0.4",
    "volume": "(CASE WHEN coalesce(volume, 0) / 1000.0::DOUBLE > 0 THEN log10(coalesce(volume, 0) / 1000.0::DOUBLE) ELSE 0 END) BETWEEN log10(0.1) AND log10(0.5)",
    "platforms": "n_platforms >= 3 AND n_platforms >= 2 AND list_has_any(platforms, ['NATION_4', 'NATION_8'])",
    "quality": "NOT conflicted AND coalesce(price, 0) > 0 AND coalesce(mcap, 0) > 0 AND coalesce(volume, 0) > 0 AND n_platforms > 0",
    "search": "(contains(lower(coalesce(name, '')), 'red') OR contains(lower(coalesce(symbol, '')), 'red'))",
}
_ONE = {
    "type": {"classes": ["fiat", "other"]},
    "price": {"price": (900.0, 980.0)},
    "mcap": {"mcap_millions": (0.2, 0.4)},
    "volume": {"volume_thousands": (0.1, 0.5), "volume_log": True},
    "platforms": {"least_platforms": 3, "cross_chain": True, "platforms": ["NATION_4", "NATION_8"]},
    "quality": {"hide_conflicts": True, "complete": True},
    "search": {"search": "Red"},
}


def _filter(name: str, part: str) -> None:
    @query(name, with_(*V, body=f"SELECT asset_key FROM vw WHERE {_W[part]}"))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return kept(spark, d, **_ONE[part])


for _name, _part in (("filter_asset_type", "type"), ("filter_price_range", "price"), ("filter_mcap_range", "mcap"), ("filter_volume_range", "volume"), ("filter_platforms", "platforms"), ("filter_quality", "quality"), ("filter_search", "search")):
    _filter(_name, _part)

_SOME = ("type", "mcap", "platforms", "quality")


@query("filter_pipeline", with_(*V, body="SELECT asset_key FROM vw WHERE " + " AND ".join(_W[p] for p in _SOME)))
def filter_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, **{k: v for p in _SOME for k, v in _ONE[p].items()})


@query("filtered_counts", with_(*V, body=f"SELECT count(*) FILTER (WHERE {_W['type']} AND {_W['quality']}) AS kept, count(*) AS n FROM vw"))
def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    condition = fl.Filters(**_ONE["type"], **_ONE["quality"]).condition()
    return view(spark, d).agg(F.count_if(condition).alias("kept"), F.count(F.lit(1)).alias("n"))


@query("lookup_asset", with_(*ALL, body="SELECT asset_key, name, symbol FROM merged WHERE lower(slug) = 'a42' OR lower(symbol) = 'a42' ORDER BY asset_key LIMIT 1"))
def lookup_asset(spark: SparkSession, d: str) -> DataFrame:
    return views.first_match(merged(spark, d), "A42", "slug", "symbol", tie="asset_key").select("asset_key", "name", "symbol")


@query("view_row_valid", with_(*ALL, body="SELECT valid, count(*) AS n FROM (SELECT coalesce(nullif(name, ''), nullif(symbol, '')) IS NOT NULL AND price IS NOT NULL AS valid FROM merged) GROUP BY valid"))
def row_valid(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).groupBy(view_row_valid().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("view_required_fields", with_(*ALL, body="SELECT count(*) FILTER (WHERE name IS NULL) AS no_name, count(*) FILTER (WHERE symbol IS NULL) AS no_symbol, count(*) FILTER (WHERE price IS NULL OR mcap IS NULL) AS no_main, count(*) FILTER (WHERE rank IS NULL) AS no_rank FROM merged"))
def view_required_fields(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).agg(F.count_if(F.col("name").isNull()).alias("no_name"), F.count_if(F.col("symbol").isNull()).alias("no_symbol"), F.count_if(F.col("price").isNull() | F.col("mcap").isNull()).alias("no_main"), F.count_if(F.col("rank").isNull()).alias("no_rank"))


@query("rank_by_category", with_(*ALL, body="SELECT asset_key, category, mcap, row_number() OVER (ORDER BY CASE WHEN category = 'Stablecoin' THEN 0 ELSE 1 END, mcap DESC NULLS LAST, asset_key) AS rank FROM merged"))
def rank_by_category(spark: SparkSession, d: str) -> DataFrame:
    by = [F.when(F.col("category") == "Stablecoin", 0).otherwise(1), F.col("mcap").desc_nulls_last(), F.col("asset_key")]
    return views.ranked(merged(spark, d).select("asset_key", "category", "mcap"), *by)


@query("top_assets", with_(*ALL, body="SELECT asset_key, mcap FROM merged WHERE mcap IS NOT NULL ORDER BY mcap DESC, asset_key LIMIT 20"))
def top_assets(spark: SparkSession, d: str) -> DataFrame:
    return views.top(merged(spark, d).where("mcap IS NOT NULL").select("asset_key", "mcap"), 20, F.col("mcap").desc(), F.col("asset_key"))


@query("top_n_others", with_(*ALL, body="""
, valid AS (SELECT asset_key, mcap FROM merged WHERE mcap > 0), best AS (SELECT * FROM valid ORDER BY mcap DESC, asset_key LIMIT 8), w AS (SELECT sum(mcap) AS w FROM valid)
SELECT asset_key AS label, round(mcap / w * 100, 6) AS share FROM best, w UNION ALL SELECT 'Others', round((w - (SELECT sum(mcap) FROM best)) / w * 100, 6) FROM w"""))
def top_n_others(spark: SparkSession, d: str) -> DataFrame:
    return views.top_and_others(merged(spark, d), "asset_key", "mcap", 8).select("label", F.round("share", 6).alias("share"))


@query("facet_values", with_(*V, body="SELECT DISTINCT 'peg' AS facet, peg AS value FROM vw WHERE peg <> '' UNION ALL SELECT DISTINCT 'category', category FROM vw UNION ALL SELECT DISTINCT 'platform', unnest(platforms) FROM vw"))
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d)
    each = rows.select(F.explode("platforms").alias("platform"))
    return views.facets(rows, "peg", "category").union(views.facets(each, "platform"))


@query("summary_stats", with_(*V, body="SELECT count(*) AS n, count(mcap) AS n_mcap, count(*) FILTER (WHERE n_platforms > 0) AS n_on_platforms, round(count(mcap)::DOUBLE / count(*), 6) AS completeness FROM vw"))
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count("mcap").alias("n_mcap"), F.count_if(F.col("n_platforms") > 0).alias("n_on_platforms"), F.round(F.count("mcap") / F.count(F.lit(1)), 6).alias("completeness"))


@query("sort_by_column", with_(*ALL, body="SELECT asset_key, website FROM merged ORDER BY website NULLS LAST, asset_key"))
def sort_by_column(spark: SparkSession, d: str) -> DataFrame:
    return views.sort_by(merged(spark, d).select("asset_key", "website"), "website", None, "asset_key")


@query("sort_by_param", with_(*V, body="SELECT asset_key, n_platforms FROM vw ORDER BY n_platforms DESC, asset_key"))
def sort_by_param(spark: SparkSession, d: str) -> DataFrame:
    return views.sort_by_param(view(spark, d).select("asset_key", "n_platforms"), "blockchains", "asset_key")


@query("dominance", with_(*ALL, body="SELECT asset_key, CASE WHEN mcap > 0 AND w > 0 THEN round(least(100, floor(mcap / w * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE), 2) END AS dominance FROM merged, (SELECT sum(mcap) AS w FROM merged)"))
def dominance(spark: SparkSession, d: str) -> DataFrame:
    rows = merged(spark, d).select("asset_key", "mcap")
    whole = rows.agg(F.sum("mcap").alias("w"))
    return rows.join(F.broadcast(whole)).select("asset_key", F.round(views.dominance(F.col("mcap"), F.col("w")), 2).alias("dominance"))


@query("elig_listings", with_(*ASSETS, body="SELECT asset_key, source FROM keyed WHERE (category = 'Stablecoin' AND (price IS NULL OR price / 1000 BETWEEN 0.95 AND 1.1)) OR category = 'Tokenized Asset'"))
def elig_listings(spark: SparkSession, d: str) -> DataFrame:
    rows = keyed(spark, d).withColumn("price", F.col("price") / 1000)
    sane = (F.col("category") == "Stablecoin") & fl.price_sane(F.col("price"), 0.95, 1.1)
    return rows.where(sane | (F.col("category") == "Tokenized Asset")).select("asset_key", "source")


@query("elig_supply_metrics", with_(*ASSETS, body="SELECT asset_key, source FROM keyed WHERE symbol <> '' AND name <> '' AND (len(list_filter(tags, lambda t: contains(lower(t), 'stable') OR contains(lower(t), 'currency'))) > 0 OR regexp_matches(symbol, '(?i)" + tx.KNOWN_STABLE + "') OR regexp_matches(name, '(?i)" + tx.KNOWN_STABLE + "'))"))
def elig_supply_metrics(spark: SparkSession, d: str) -> DataFrame:
    return fl.elig_supply_metrics(keyed(spark, d)).select("asset_key", "source")


SUPPLY = """
cs AS (SELECT key, source, CASE WHEN key % 5 = 0 THEN 'Wrapped ' || name WHEN key % 17 = 0 THEN 'wETH' ELSE name END AS name, symbol, CASE WHEN key % 3 = 0 THEN 'peggedUSD' WHEN key % 3 = 1 THEN 'peggedBTC' ELSE 'peggedEUR' END AS peg_type,
  price / 1000 * CASE WHEN key % 4 = 0 THEN 3 ELSE 1 END AS price, circulating, CASE WHEN key % 3 = 0 THEN circulating END AS circulating_usd, mcap FROM src_asset),
ok AS (SELECT * FROM cs WHERE symbol <> '' AND name <> '' AND circulating IS NOT NULL AND NOT regexp_matches(name, '(?i)wrapped|liquid|staked|yield|reward|pool|vault|interest|synthetic') AND NOT regexp_matches(symbol, '(?i)wrapped|liquid|staked|yield|reward|pool|vault|interest|synthetic')
  AND NOT regexp_matches(name, '^w[A-Z]+$') AND (peg_type <> 'peggedUSD' OR price BETWEEN 0.5 AND 2.0))"""


def supply_rows(spark: SparkSession, d: str) -> DataFrame:
    from assetweave.plans.bindings import src_asset

    k = F.col("key")
    return src_asset(spark, d).select("key", "source", F.when(k % 5 == 0, F.concat(F.lit("Wrapped "), "name")).when(k % 17 == 0, "wETH").otherwise(F.col("name")).alias("name"), "symbol", F.when(k % 3 == 0, "peggedUSD").when(k % 3 == 1, "peggedBTC").otherwise("peggedEUR").alias("peg_type"), (F.col("price") / 1000 * F.when(k % 4 == 0, 3).otherwise(1)).alias("price"), "circulating", F.when(k % 3 == 0, F.col("circulating")).alias("circulating_usd"), "mcap")


from assetweave.plans.bindings import SRC_ASSET  # noqa: E402


@query("elig_chain_supply", with_(SRC_ASSET, SUPPLY, body="SELECT key, source FROM ok WHERE peg_type <> 'peggedBTC' AND upper(symbol) <> 'A6' AND (circulating_usd IS NULL OR circulating_usd >= 300)"))
def elig_chain_supply(spark: SparkSession, d: str) -> DataFrame:
    return fl.elig_chain_supply(supply_rows(spark, d), ("peggedBTC",), ("a6",), 300.0).select("key", "source")


@query("elig_chain_supply_strict", with_(SRC_ASSET, SUPPLY, body="SELECT key, source, mcap FROM ok WHERE mcap >= 100000 AND (regexp_matches(name, '(?i)usd|dollar|stable|eur|euro') OR regexp_matches(symbol, '(?i)usd|dollar|stable|eur|euro') OR regexp_matches(name, 'red')) ORDER BY mcap DESC, key LIMIT 200"))
def elig_chain_supply_strict(spark: SparkSession, d: str) -> DataFrame:
    rows = supply_rows(spark, d).withColumn("name", F.when(F.col("name").contains("red"), F.concat("name", F.lit(" euro"))).otherwise(F.col("name")))
    return fl.elig_chain_supply_strict(rows, 100_000.0).select("key", "source", "mcap")


@query("elig_markets", with_(SRC_ASSET, SUPPLY, body="SELECT key, source FROM cs WHERE price BETWEEN 0.5 AND 2.0 AND mcap >= 200000"))
def elig_markets(spark: SparkSession, d: str) -> DataFrame:
    return fl.elig_markets(supply_rows(spark, d), 200_000.0).select("key", "source")


@query("fmt_compact", "SELECT o_orderkey, CASE WHEN t >= 1000000 THEN 'M' WHEN t >= 1000 THEN 'K' ELSE '-' END AS unit, CASE WHEN o_orderkey % 10 = 0 THEN 'No data' END AS missing FROM (SELECT o_orderkey, o_totalprice * 3 AS t FROM orders)")
def fmt_compact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 3).alias("t"))
    text = exprs.fmt_compact("t")
    return rows.select("o_orderkey", F.when(F.right(text, F.lit(1)).isin("M", "K"), F.right(text, F.lit(1))).otherwise("-").alias("unit"), F.when(F.col("o_orderkey") % 10 == 0, exprs.fmt_compact(F.lit(None).cast("double"))).alias("missing"))


@query("fmt_grouped", "SELECT o_orderkey, format('{:,}', floor(o_totalprice)::BIGINT) AS grouped, '$' || format('{:,}', floor(o_totalprice)::BIGINT) || '.000' AS price, format('{:,}', floor(o_totalprice)::BIGINT) || '.00%' AS pct FROM orders")
def fmt_grouped(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", exprs.fmt_grouped(n).alias("grouped"), exprs.fmt_price(n).alias("price"), exprs.fmt_pct(n).alias("pct"))


@query("fmt_price", "SELECT o_orderkey, '$' || format('{:,}', floor(o_totalprice)::BIGINT) || '.000' AS price FROM orders")
def fmt_price(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", exprs.fmt_price(F.floor("o_totalprice")).alias("price"))


@query("fmt_pct", "SELECT l_orderkey, l_linenumber, (l_discount * 100)::DECIMAL(9, 2)::VARCHAR || '%' AS pct FROM lineitem")
def fmt_pct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", exprs.fmt_pct(F.col("l_discount") * 100).alias("pct"))


@query("fmt_supply", "SELECT l_orderkey, l_linenumber, format('{:,}', (l_quantity * 1000)::BIGINT) AS supply FROM lineitem")
def fmt_supply(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", exprs.fmt_grouped(F.col("l_quantity") * 1000).alias("supply"))


@query("slugify", "SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name || ' ~ ' || s_suppkey || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM supplier")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", exprs.slugify(F.concat("s_name", F.lit(" ~ "), "s_suppkey", F.lit("!"))).alias("slug"))


@query("clean_numeric", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size + 0.5 WHEN p_size % 4 = 1 THEN -1000.0 * p_size WHEN p_size % 4 = 2 THEN 7.0 ELSE p_size END::DOUBLE AS n FROM part")
def clean_numeric(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("  "), s, F.lit(".5 USD"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("-"), s, F.lit("e3"))).when(F.col("p_size") % 4 == 2, "n/a").otherwise(F.concat(s, F.lit("px")))
    return table(spark, d, "part").select("p_partkey", exprs.clean_numeric(text, 7.0).alias("n"))


@query("first_valid_across", with_(*ALL, body="SELECT asset_key, round(coalesce(nullif(total, 0), nullif(circulating, 0), nullif(volume, 0), nullif(mcap, 0)), 2) AS value FROM merged"))
def first_valid_across(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select("asset_key", F.round(exprs.first_valid("total", "circulating", "volume", "mcap"), 2).alias("value"))
