"""Alignment of sources by key and the merge of their rows into one asset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetweave.functions.exprs import filled, finite

#: Fields that a merge picks, each from the source of highest priority that has it.
PICKED = ["name", "symbol", "slug", "price", "mcap", "volume", "change", "rank", "circulating", "total", "description", "website", "date_added", "peg", "category"]


def union_sources(*frames: DataFrame) -> DataFrame:
    """Stacks standardized sources; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_asset_key(rows: DataFrame) -> DataFrame:
    """rows with asset_key, the upper-case symbol, slug or name; rows without any go."""
    key = F.upper(F.coalesce(filled("symbol"), filled("slug"), filled("name")))
    return rows.withColumn("asset_key", key).where(F.col("asset_key").isNotNull())


def effective_priority(rows: DataFrame, overrides: DataFrame, declared: Column) -> DataFrame:
    """rows with priority: the override of its source (source, override), else the declared one, else 0."""
    return rows.join(F.broadcast(overrides), "source", "left").withColumn("priority", F.coalesce("override", declared, F.lit(0))).drop("override")


def order(prio: str = "prio", seq: str = "seq") -> Column:
    """One number that ranks entries: priority first, ties to the source seen first."""
    return F.col(prio).cast("long") * 1000 - F.col(seq).cast("long")


def pick(value: str, with_source: bool = False) -> Column:
    """Aggregate: the value of the best entry that has one; with_source: that entry's source."""
    return F.expr(f"max_by({'source' if with_source else value}, prio * 1000L - seq) FILTER (WHERE {value} IS NOT NULL)")


def deviation(prices: Column) -> Column:
    """Consensus of an array of finite prices, 0 to 1: how near the furthest is to the median."""
    ordered = F.array_sort(prices)
    n = F.size(ordered)
    upper = F.get(ordered, F.floor(n / F.lit(2)).cast("int"))
    median = F.when(n % 2 == 1, upper).otherwise((F.get(ordered, (F.floor(n / F.lit(2)) - 1).cast("int")) + upper) / 2)
    furthest = F.greatest(median - F.array_min(prices), F.array_max(prices) - median) / F.greatest(F.lit(1.0), median)
    return F.when((n <= 1) | (median == 0), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.least(F.lit(1.0), furthest / 0.05))))


def prices_by_source() -> Column:
    """Aggregate: finite prices. One asset has one row a source, so the array is as short as the list of sources."""
    return F.collect_list(F.when(finite("price"), F.col("price")))


def confidence(p: Column, m: Column, s: Column, consensus: Column) -> dict[str, Column]:
    """Scores from the counts of prices, market caps and supplies, and the consensus of prices."""
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    market = F.least(F.lit(1.0), 0.5 * on(p >= 1) + 0.3 * on(m >= 1) + 0.2 * consensus)
    supply = 0.8 * on(s >= 1) + 0.2 * on(s >= 2)
    overall = F.least(F.lit(1.0), (0.4 * market + 0.4 * supply + F.lit(0.1)) * (0.8 + 0.2 * F.least(F.lit(1.0), (p + m + s) / F.lit(6.0))))
    return {"conf_market": market, "conf_supply": supply, "conf_platform": F.lit(0.5), "conf_overall": overall}


def merge_assets(rows: DataFrame) -> DataFrame:
    """One row per asset_key of rows (asset_key, source, seq, prio and the picked fields): one shuffle."""
    aggs = [pick(f).alias(f) for f in PICKED] + [pick(f, True).alias(f"{f}_source") for f in ("price", "mcap", "volume", "circulating")]
    counts = [F.count(F.when(finite(c), 1)).alias(f"n_{c}") for c in ("price", "mcap", "circulating")]
    got = rows.groupBy("asset_key").agg(*aggs, *counts, prices_by_source().alias("prices"), F.array_sort(F.collect_set("source")).alias("sources"))
    got = got.withColumn("consensus", deviation(F.col("prices")))
    got = got.withColumns(confidence(F.col("n_price"), F.col("n_mcap"), F.col("n_circulating"), F.col("consensus")))
    return got.withColumns(
        {
            "name": F.coalesce("name", "asset_key"),
            "slug": F.coalesce("slug", F.lower("symbol"), F.lower("asset_key")),
            "symbol": F.coalesce(F.upper("symbol"), "asset_key"),
            "category": F.coalesce("category", F.lit("Stablecoin")),
        }
    )


def capabilities(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, source, prio, n, place): which sources give a field, in how many rows, from the best one of each field.

    rows: source, seq, prio and the fields; a source that never fills a field doesn't have it. Ties go to the lower seq.
    """
    counts = rows.groupBy("source").agg(F.max("prio").alias("prio"), F.min("seq").alias("seq"), *[F.count(f).alias(f) for f in fields])
    each = counts.select("source", "prio", "seq", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("x")).select("x.field", "source", "prio", "seq", "x.n").where("n > 0")
    # a row for each source and field by now
    return each.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(F.col("prio").desc(), "seq"))).drop("seq")


def union_networks(rows: DataFrame) -> DataFrame:
    """Of rows (asset_key, seq, pos, network, contract, ...) the first of each network and contract of an asset."""
    same = [F.lower("network"), F.lower(F.coalesce("contract", F.lit("")))]
    first = Window.partitionBy("asset_key", *same).orderBy("seq", "pos")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def breakdown_override(assets: DataFrame, chains: DataFrame, networks: DataFrame) -> DataFrame:
    """The chain rows of assets that have any, else their network rows; all (asset_key, network, supply)."""
    has = chains.select("asset_key").distinct()
    return assets.select("asset_key").join(chains, "asset_key").unionByName(assets.select("asset_key").join(networks, "asset_key").join(has, "asset_key", "left_anti"))


def field_conflicts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(asset_key, field, n_values, values): fields of which sources give different values, case aside."""
    long = rows.select("asset_key", "source", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("asset_key", "source", "x.field", "x.value").where("value <> ''")
    got = long.groupBy("asset_key", "field").agg(F.count(F.lit(1)).alias("n_entries"), F.array_sort(F.collect_set(F.lower("value"))).alias("distinct_values"), F.array_sort(F.collect_set(F.struct("source", "value"))).alias("by_source"))
    return got.where((F.col("n_entries") >= 2) & (F.size("distinct_values") > 1))
