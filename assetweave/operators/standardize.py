"""Rows of the sources' snapshots in one shape.

Standard rows have source, id, name, symbol, slug, price, mcap, volume, change, rank, circulating, total, max_supply,
networks (array of name, network, contract, supply, percentage), tags, description, website, logo, date_added,
peg_type and confidence; the classifier adds category and peg.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave.functions.exprs import filled, literal_map, truthy

NETWORK = "struct<name:string,network:string,contract:string,supply:double,percentage:double>"
#: Metals by code, and where logos are found.
METALS = {"XAU": "Gold", "XAG": "Silver"}
LOGO = "https://s2.coinmarketcap.com/static/img/coins/64x64/%s.png"


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def peg_of_type(peg_type: Column) -> Column:
    """peggedXYZ -> XYZ, or the metal's name; null for anything else."""
    code = filled(F.regexp_extract(peg_type, r"^pegged([A-Z0-9]+)\z", 1))
    return F.coalesce(F.try_element_at(literal_map(METALS), code), code)


def _row(source: str, **columns: Column) -> list[Column]:
    kinds = {"id": "string", "name": "string", "symbol": "string", "slug": "string", "price": "double", "mcap": "double", "volume": "double", "change": "double", "rank": "int", "circulating": "double", "total": "double", "max_supply": "double", "networks": f"array<{NETWORK}>", "tags": "array<string>", "description": "string", "website": "string", "logo": "string", "date_added": "string", "peg_type": "string", "confidence": "double"}
    return [F.lit(source).alias("source"), *[columns.get(c, null(k)).cast(k).alias(c) for c, k in kinds.items()]]


def _network(name: Column, network: Column, contract: Column, supply: Column, percentage: Column) -> Column:
    return F.struct(name.cast("string").alias("name"), network.cast("string").alias("network"), contract.cast("string").alias("contract"), supply.cast("double").alias("supply"), percentage.cast("double").alias("percentage"))


def std_listings(raw: DataFrame) -> DataFrame:
    usd, c = F.col("quote.USD"), F.col
    circulating = F.coalesce(F.try_divide(truthy(usd["market_cap"]), truthy(usd["price"])), c("circulating_supply"))
    networks = F.when(c("platform").isNotNull(), F.array(_network(F.coalesce(filled("platform.name"), F.lit("Unknown")), F.lower(F.coalesce(filled("platform.slug"), filled("platform.symbol"))), filled("platform.token_address"), null("double"), null("double")))).otherwise(F.array().cast(f"array<{NETWORK}>"))
    return raw.select(*_row("cmc", id=c("id"), name=c("name"), symbol=F.upper("symbol"), slug=F.lower(F.coalesce(filled("slug"), c("symbol"))), price=usd["price"], mcap=usd["market_cap"], volume=usd["volume_24h"], change=usd["percent_change_24h"], rank=c("cmc_rank"), circulating=circulating, total=c("total_supply"), max_supply=c("max_supply"), networks=networks, tags=F.coalesce("tags", F.array()), logo=F.when(c("id").isNotNull(), F.format_string(LOGO, c("id").cast("string"))), date_added=c("date_added"), confidence=F.lit(0.9)))


def std_supply_metrics(raw: DataFrame) -> DataFrame:
    """raw has networks under the first non-empty of six names, as sources.scan_supply_metrics reads them."""
    c = F.col
    one = lambda x: _network(F.coalesce(filled(x["name"]), x["network"]), F.coalesce(filled(x["network"]), x["name"]), F.coalesce(filled(x["contract"]), x["contract_address"]), F.coalesce(x["supply"], x["amount"]), F.coalesce(x["percentage"], x["share"]))
    networks = F.filter(F.transform(F.coalesce("breakdown", F.array()), one), lambda x: x["name"].isNotNull() & (x["name"] != ""))
    circulating = c("supply.circulating")
    return raw.select(*_row("messari", id=c("id"), name=c("name"), symbol=F.upper("symbol"), slug=F.lower(F.coalesce(filled("slug"), c("symbol"))), price=F.lit(1.0), mcap=circulating, circulating=circulating, total=c("supply.total"), max_supply=c("supply.max"), networks=networks, tags=F.coalesce("tags", F.array()), description=c("profile.general.overview.project_details"), website=F.get(c("profile.general.overview.official_links"), F.lit(0))["link"], logo=c("profile.images.logo"), confidence=F.lit(0.85)))


def std_chain_supply(raw: DataFrame) -> DataFrame:
    c = F.col
    amount = lambda m: F.coalesce(truthy(m["peggedUSD"]), truthy(m["peggedEUR"]), truthy(m["peggedBTC"]), F.get(F.map_values(m), F.lit(0)))
    circulating = amount(c("circulating"))
    chain = lambda e: _network(e["key"], F.lower(e["key"]), F.lit(""), amount(e["value"]["current"]), F.when(c("_circulating") > 0, amount(e["value"]["current"]) / c("_circulating") * 100))
    rows = raw.withColumn("_circulating", circulating)
    networks = F.filter(F.transform(F.map_entries(F.coalesce("chainCirculating", F.map_from_arrays(F.array(), F.array()).cast(dict(raw.dtypes)["chainCirculating"]))), chain), lambda x: x["supply"] > 0)
    tags = F.array_compact(F.array(F.lit("stablecoin"), c("pegType"), F.when(F.lower("pegMechanism").contains("fiat"), "fiat-stablecoin").when(F.lower("pegMechanism").contains("crypto"), "asset-backed-stablecoin").when(F.lower("pegMechanism").contains("algo"), "algorithmic-stablecoin")))
    return rows.select(*_row("defillama", id=c("id"), name=c("name"), symbol=F.upper("symbol"), slug=F.regexp_replace(F.lower("name"), r"\s+", "-"), price=c("price"), mcap=c("_circulating") * c("price"), circulating=c("_circulating"), networks=networks, tags=tags, peg_type=c("pegType"), confidence=F.lit(0.8)))


def std_markets(raw: DataFrame) -> DataFrame:
    c = F.col
    return raw.select(*_row("coingecko", id=c("id"), name=c("name"), symbol=F.upper("symbol"), slug=F.lower("id"), price=c("current_price"), mcap=c("market_cap"), volume=c("total_volume"), change=c("price_change_percentage_24h"), rank=c("market_cap_rank"), circulating=c("circulating_supply"), total=c("total_supply"), networks=F.array(), tags=F.array(F.lit("coingecko")), logo=c("image"), confidence=F.lit(0.6)))


def adapt_for_view(merged: DataFrame) -> DataFrame:
    """Merged assets as a viewer shows them: caps from supply where missing, default tags, an image."""
    image = F.coalesce(filled("logo"), F.when(F.col("id").rlike(r"^[0-9]+\z"), F.format_string(LOGO, F.col("id"))))
    tags = F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, F.col("tags")).otherwise(F.array(F.lit("stablecoin")))
    return merged.withColumns({"mcap": F.coalesce(truthy("mcap"), F.col("circulating") * F.col("price")), "tags": tags, "image": image})


def view_row_valid() -> Column:
    return (F.coalesce(filled("name"), filled("symbol")).isNotNull()) & F.col("price").isNotNull()
