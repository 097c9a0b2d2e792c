"""Names of platforms, chains in long form and roll-ups by platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetweave.functions import taxonomy as tx
from assetweave.functions.exprs import col, literal_map, percent, slugify, trimmed

#: The smaller sets of aliases, and of parts of names, that merging and fetching use.
V2 = [k for k in tx.PLATFORM_ALIASES if k in set("ethereum tron binance bsc polygon solana avalanche arbitrum optimism base bitcoin stellar algorand cardano near flow hedera sui aptos manta thundercore ton cronos mantle linea scroll blast zksync fantom celo harmony".split())]
V3 = [k for k in tx.PLATFORM_ALIASES if k in set("ethereum binance bsc polygon tron solana avalanche arbitrum optimism base bitcoin stellar algorand cardano near flow hedera sui aptos".split())]
V3_CONTAINS = [("ethereum", "Ethereum"), ("binance", "BSC"), ("bsc", "BSC"), ("polygon", "Polygon"), ("tron", "Tron"), ("solana", "Solana"), ("avalanche", "Avalanche"), ("arbitrum", "Arbitrum"), ("optimism", "Optimism")]


def _name(raw: Column, aliases: dict[str, str], contains: list[tuple[str, str]]) -> Column:
    low = trimmed(F.lower(raw))
    parts = [F.when(low.contains(p), name) for p, name in contains]
    capital = F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(F.substring(raw, 2, 1_000_000)))
    return F.when(raw.isNull() | (raw == ""), "Unknown").otherwise(F.coalesce(F.try_element_at(literal_map(aliases), low), *parts, capital))


def platform_name(raw: Column | str) -> Column:
    """Display name: by alias, by part of the name, else with a capital."""
    return _name(col(raw), tx.PLATFORM_ALIASES, tx.PLATFORM_CONTAINS)


def platform_name_v2(raw: Column | str) -> Column:
    return _name(col(raw), {k: tx.PLATFORM_ALIASES[k] for k in V2}, [])


def platform_name_v3(raw: Column | str) -> Column:
    return _name(col(raw), {k: tx.PLATFORM_ALIASES[k] for k in V3}, V3_CONTAINS)


def platform_known(raw: Column | str) -> Column:
    return platform_name(raw).isin(sorted(set(tx.PLATFORM_ALIASES.values())))


def chain_long(assets: DataFrame, chains: str = "chainCirculating") -> DataFrame:
    """Rows (id, chain, pos, current, prev_day, prev_week, prev_month) of a map chain -> amounts by peg."""
    amount = lambda m: F.coalesce(F.nullif(m["peggedUSD"], F.lit(0.0)), F.nullif(m["peggedEUR"], F.lit(0.0)), F.get(F.map_values(m), F.lit(0)))
    return assets.select("id", F.posexplode(F.map_entries(chains)).alias("pos", "x")).select(
        "id", F.col("x.key").alias("chain"), "pos", amount(F.col("x.value.current")).alias("current"), amount(F.col("x.value.circulatingPrevDay")).alias("prev_day"), amount(F.col("x.value.circulatingPrevWeek")).alias("prev_week"), amount(F.col("x.value.circulatingPrevMonth")).alias("prev_month")
    )


def extract_platforms(tiers: DataFrame) -> DataFrame:
    """Of rows (key, tier, pos, name) each asset's lowest tier, one row per normalized name, first wins."""
    lowest = Window.partitionBy("key")
    rows = tiers.withColumn("_least", F.min("tier").over(lowest)).where(F.col("tier") == F.col("_least")).withColumn("platform", platform_name("name"))
    first = Window.partitionBy("key", "platform").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("key", "tier", "platform", "pos")


def cross_chain(chains: DataFrame) -> DataFrame:
    """Per asset and chain (normalized): supply, share of the asset's total, whether it leads.

    Where two names of a chain become one, the later row stands in the breakdown and both count in the total; the
    leading chain is the first with most supply.
    """
    rows = chains.where("current > 0").withColumn("chain_name", platform_name("chain"))
    newest, lead = F.max_by(F.struct("current", "prev_day", "prev_week", "prev_month"), "pos"), F.max(F.struct("current", (-F.col("pos")).alias("p")))
    each = rows.groupBy("key", "chain_name").agg(newest.alias("x"), F.sum("current").alias("sum"), lead.alias("lead"))
    # an asset has few chains
    asset = Window.partitionBy("key")
    whole = each.withColumns({"total": F.sum("sum").over(asset), "dominant": F.max_by("chain_name", "lead").over(asset)})
    return whole.select("key", "chain_name", "x.*", "total", "dominant").withColumn("percentage", F.col("current") / F.col("total") * 100)


def supply_change(chains: DataFrame) -> DataFrame:
    """chains with the change against a day, a week and a month before, absolute and in percent."""
    return chains.withColumns({f"change_{p}": F.col("current") - F.col(f"prev_{p}") for p in ("day", "week", "month")} | {f"pct_{p}": F.try_divide((F.col("current") - F.col(f"prev_{p}")) * 100, F.col(f"prev_{p}")) for p in ("day", "week", "month")})


def allocated(rows: DataFrame) -> DataFrame:
    """rows (key, platform, supply, mcap) with alloc, the share of the asset's cap that falls to the platform."""
    asset = Window.partitionBy("key")
    rows = rows.withColumns({"asset_supply": F.sum(F.coalesce("supply", F.lit(0.0))).over(asset), "n_platforms": F.count(F.lit(1)).over(asset)})
    alloc = F.when((F.col("asset_supply") > 0) & (F.col("supply") > 0), F.col("mcap") * (F.col("supply") / F.col("asset_supply"))).when(F.col("n_platforms") == 1, F.col("mcap")).otherwise(0.0)
    return rows.withColumn("alloc", alloc)


def rollup(rows: DataFrame) -> DataFrame:
    """Per platform of allocated rows (key, symbol, platform, supply, alloc): caps, counts, supply and share."""
    got = rows.groupBy("platform").agg(F.sum("alloc").alias("mcap_sum"), F.count(F.lit(1)).alias("coin_count"), F.sum(F.when(F.col("supply") > 0, F.col("supply")).otherwise(0.0)).alias("total_supply"))
    # one row a platform by now, so the window over all of them is small
    got = got.withColumn("all_supply", F.sum("total_supply").over(Window.partitionBy()))
    return got.select("platform", slugify("platform").alias("uri"), "mcap_sum", "coin_count", "total_supply", percent("total_supply", "all_supply").alias("supply_percentage"))


def breakdown(rows: DataFrame) -> DataFrame:
    """Per platform and symbol: supply and its share of the platform's."""
    rows = rows.where("supply > 0")
    got = rows.groupBy("platform", "symbol").agg(F.sum("supply").alias("supply"), F.min("key").alias("first"))
    whole = rows.groupBy("platform").agg(F.sum("supply").alias("_whole"))
    return got.join(whole, "platform").withColumn("percentage", percent("supply", "_whole")).drop("_whole")


def dominant(rows: DataFrame) -> DataFrame:
    """Per platform the symbol with most supply; of equals the first seen."""
    return breakdown(rows).groupBy("platform").agg(F.max_by(F.struct("symbol", "supply"), F.struct("supply", (-F.col("first")).alias("f"))).alias("x")).select("platform", "x.symbol", "x.supply")


def members(rows: DataFrame) -> DataFrame:
    """Per platform each symbol once, its first row."""
    w = Window.partitionBy("platform", "symbol").orderBy("key")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
