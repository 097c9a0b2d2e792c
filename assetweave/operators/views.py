"""Ranked, limited and sorted views, shares and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetweave.functions.exprs import finite, half_up
from assetweave.operators.ordered import numbered


def ranked(rows: DataFrame, *by: Column) -> DataFrame:
    """rows with rank, from 1, in the order of by, without a window over all rows."""
    return numbered(rows, list(by))


def top(rows: DataFrame, n: int, *by: Column) -> DataFrame:
    return rows.orderBy(*by).limit(n)


def top_per_group(rows: DataFrame, group: str, k: int, *by: Column) -> DataFrame:
    """The first k rows of each group with place, and more: how many follow."""
    # a row number with a limit is cut down before the shuffle, and so are counts
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("place") <= k)
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    return best.join(sizes, group).withColumn("more", F.greatest(F.lit(0), F.col("_size") - k)).drop("_size")


def top_and_others(rows: DataFrame, label: str, measure: str, n: int = 8) -> DataFrame:
    """(label, share): percent of the n rows with most of a measure, and of all others; positive finite values count."""
    valid = rows.where(finite(measure) & (F.col(measure) > 0)).select(F.col(label).alias("label"), F.col(measure).alias("value"))
    best = valid.orderBy(F.col("value").desc(), "label").limit(n)
    whole = F.broadcast(valid.agg(F.sum("value").alias("whole")))
    others = best.agg(F.sum("value").alias("top")).join(whole).where("whole > top + 1e-9").select(F.lit("Others").alias("label"), (F.col("whole") - F.col("top")).alias("value"))
    return best.unionByName(others).join(whole).select("label", (F.col("value") / F.col("whole") * 100).alias("share"))


def sort_by(rows: DataFrame, column: str, descending: bool | None = None, *ties: str) -> DataFrame:
    """Sorted by any column: numbers from the largest, texts from A, unless told; nulls last."""
    if descending is None:
        descending = dict(rows.dtypes)[column] not in ("string", "boolean")
    by = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return rows.orderBy(by, *ties)


#: Names of sort keys that a viewer may give.
SORT_KEYS = {"mcap": "mcap", "volume": "volume", "price": "price", "blockchains": "n_platforms"}


def sort_by_param(rows: DataFrame, param: str, *ties: str) -> DataFrame:
    return sort_by(rows, SORT_KEYS.get(param, "mcap"), True, *ties)


def dominance(part: Column, whole: Column) -> Column:
    """Percent of the whole, two digits, at most 100; null where either isn't positive."""
    return F.when((part > 0) & (whole > 0), F.least(F.lit(100.0), half_up(part / whole * 100, 2)))


def platform_rank_text(rank: Column, metric: str = "supply") -> Column:
    by = " by supply" if metric == "supply" else " by market cap"
    band = F.when(rank == 1, f" (Leading{by})").when(rank <= 3, f" (Top 3{by})").when(rank <= 5, f" (Top 5{by})").when(rank <= 10, f" (Top 10{by})").otherwise(by)
    return F.concat(F.lit("#"), rank.cast("string"), band)


def share_of_asset(part: Column, whole: Column) -> tuple[Column, Column]:
    """Percent of an asset's supply that a platform has, and whether the two agree."""
    ok = (part >= 0) & (whole > 0)
    status = F.when(~F.coalesce(ok, F.lit(False)), "missing").when(part > whole, "inconsistent").otherwise("ok")
    return F.when(ok, half_up(part / F.when(whole > 0, whole) * 100, 2)), status


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """(facet, value): distinct non-empty values of several columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("x")).select("x.*").where("value <> ''").distinct()


def first_match(rows: DataFrame, wanted: str, *keys: str, tie: str) -> DataFrame:
    """The first row of which some key, case aside, is wanted; earlier keys before later ones."""
    hit = F.coalesce(*[F.when(F.lower(F.col(k)) == wanted.lower(), i) for i, k in enumerate(keys)])
    return rows.withColumn("_hit", hit).where("_hit IS NOT NULL").orderBy("_hit", tie).limit(1).drop("_hit")
