"""Canonical tables made from the driver's tables, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_NAMES = ["cmc", "messari", "coingecko", "defillama"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def src_asset(spark: SparkSession, folder: str) -> DataFrame:
    """One row per asset and source that lists it, as the sources would give it.

    A source lists four fifths of the assets that it has sales of, so that sources disagree on what there is.
    """
    sold = (
        table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("key"), (F.col("l_suppkey") % 4).cast("int").alias("seq"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("mcap"), F.round(F.sum("l_quantity"), 2).alias("volume"))
        .where("(key + 3 * seq) % 5 <> 0")
    )
    rows = sold.join(table(spark, folder, "part"), F.col("key") == F.col("p_partkey"))
    return rows.selectExpr(
        "key",
        "element_at(array('cmc', 'messari', 'coingecko', 'defillama'), seq + 1) AS source",
        "seq",
        "element_at(array(10, 8, 6, 4), seq + 1) AS prio",
        "CASE WHEN key % 77 = 0 THEN concat('Asset ', key) ELSE concat(p_name, ' ', key) END AS name",
        "CASE WHEN key % 7 <> 0 THEN concat('a', key) END AS symbol",
        "CASE WHEN key % 11 <> 0 THEN concat('a', key) END AS slug",
        "CASE WHEN seq = 1 THEN p_retailprice ELSE p_retailprice * (1D + ((key * 7 + seq * 3) % 11 - 5) / 200D) END AS price",
        "mcap",
        "CASE WHEN seq <> 3 THEN volume END AS volume",
        "((key * 13 + seq * 5) % 21 - 10) / 10D AS change",
        "CASE WHEN seq = 0 THEN cast(key % 500 + 1 AS int) END AS rank",
        "CASE WHEN seq <> 2 THEN volume * 2D END AS circulating",
        "CASE WHEN seq <> 2 AND key % 3 = 0 THEN volume * 3D END AS total",
        "CASE WHEN seq IN (0, 1) THEN concat(source, ' describes ', key) END AS description",
        "CASE WHEN seq <> 3 AND key % 2 = 0 THEN concat('https://', lower(replace(p_brand, '#', '')), '.example') END AS website",
        "CASE WHEN seq = 0 THEN p_brand END AS date_added",
        "element_at(array('USD', 'EUR', 'Gold', 'usd'), cast((p_size + CASE WHEN key % 10 = 0 THEN seq ELSE 0 END) % 4 AS int) + 1) AS peg",
        "CASE WHEN seq = 2 THEN 'Other' WHEN p_size % 3 = 0 THEN 'Tokenized Asset' ELSE 'Stablecoin' END AS category",
        "array(lower(p_type), CASE WHEN p_size % 3 = 0 THEN 'tokenized-assets' ELSE 'stablecoin' END, concat('via-', source)) AS tags",
    )


SRC_ASSET = """
sold AS (SELECT key, seq, round(sum(l_extendedprice), 2) AS mcap, round(sum(l_quantity), 2) AS volume
         FROM (SELECT *, l_partkey AS key, (l_suppkey % 4)::INT AS seq FROM lineitem) WHERE (key + 3 * seq) % 5 <> 0 GROUP BY key, seq),
src_asset AS (SELECT key, source, seq, ([10, 8, 6, 4])[seq + 1] AS prio,
  CASE WHEN key % 77 = 0 THEN 'Asset ' || key ELSE p_name || ' ' || key END AS name,
  CASE WHEN key % 7 <> 0 THEN 'a' || key END AS symbol, CASE WHEN key % 11 <> 0 THEN 'a' || key END AS slug,
  CASE WHEN seq = 1 THEN p_retailprice ELSE p_retailprice * (1::DOUBLE + ((key * 7 + seq * 3) % 11 - 5)::DOUBLE / 200::DOUBLE) END AS price,
  mcap, CASE WHEN seq <> 3 THEN volume END AS volume, ((key * 13 + seq * 5) % 21 - 10)::DOUBLE / 10::DOUBLE AS change,
  CASE WHEN seq = 0 THEN (key % 500 + 1)::INT END AS rank, CASE WHEN seq <> 2 THEN volume * 2::DOUBLE END AS circulating,
  CASE WHEN seq <> 2 AND key % 3 = 0 THEN volume * 3::DOUBLE END AS total,
  CASE WHEN seq IN (0, 1) THEN source || ' describes ' || key END AS description,
  CASE WHEN seq <> 3 AND key % 2 = 0 THEN 'https://' || lower(replace(p_brand, '#', '')) || '.example' END AS website,
  CASE WHEN seq = 0 THEN p_brand END AS date_added,
  (['USD', 'EUR', 'Gold', 'usd'])[((p_size + CASE WHEN key % 10 = 0 THEN seq ELSE 0 END) % 4)::INT + 1] AS peg,
  CASE WHEN seq = 2 THEN 'Other' WHEN p_size % 3 = 0 THEN 'Tokenized Asset' ELSE 'Stablecoin' END AS category,
  [lower(p_type), CASE WHEN p_size % 3 = 0 THEN 'tokenized-assets' ELSE 'stablecoin' END, 'via-' || source] AS tags
  FROM (SELECT *, (['cmc', 'messari', 'coingecko', 'defillama'])[seq + 1] AS source FROM sold) JOIN part ON key = p_partkey)"""


def asset_platform(spark: SparkSession, folder: str) -> DataFrame:
    """Supply of each asset on each platform, with the platform's place in the asset's list."""
    where = table(spark, folder, "supplier").join(F.broadcast(table(spark, folder, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "n_nationkey")
    rows = table(spark, folder, "lineitem").join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("l_partkey").alias("key"), F.col("n_name").alias("platform"), F.col("n_nationkey").alias("pos")).agg(F.round(F.sum(F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity")).otherwise(0.0)), 2).alias("supply"))


ASSET_PLATFORM = """
asset_platform AS (SELECT l_partkey AS key, n_name AS platform, n_nationkey AS pos,
  round(sum(CASE WHEN l_partkey % 9 <> 0 THEN l_quantity ELSE 0.0 END), 2) AS supply
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def chain_history(spark: SparkSession, folder: str) -> DataFrame:
    """Supply of each asset on each chain now and a day, a week and a month before the last shipment."""
    last = table(spark, folder, "lineitem").agg(F.max("l_shipdate").alias("last"))
    where = table(spark, folder, "supplier").join(F.broadcast(table(spark, folder, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("chain"), F.col("n_nationkey").cast("int").alias("pos"))
    rows = table(spark, folder, "lineitem").join(where, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(last))
    before = lambda days: F.round(F.sum(F.when(F.col("l_shipdate") <= F.col("last") - F.expr(f"INTERVAL {days} DAYS"), F.col("l_quantity")).otherwise(0.0)), 2)
    return rows.groupBy(F.col("l_partkey").alias("key"), "chain", "pos").agg(F.round(F.sum("l_quantity"), 2).alias("current"), before(1).alias("prev_day"), before(7).alias("prev_week"), before(30).alias("prev_month"))


CHAIN_HISTORY = """
chain_history AS (SELECT l_partkey AS key, n_name AS chain, n_nationkey::INT AS pos, round(sum(l_quantity), 2) AS current,
  round(sum(CASE WHEN l_shipdate <= last - INTERVAL 1 DAY THEN l_quantity ELSE 0.0 END), 2) AS prev_day,
  round(sum(CASE WHEN l_shipdate <= last - INTERVAL 7 DAY THEN l_quantity ELSE 0.0 END), 2) AS prev_week,
  round(sum(CASE WHEN l_shipdate <= last - INTERVAL 30 DAY THEN l_quantity ELSE 0.0 END), 2) AS prev_month
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey, (SELECT max(l_shipdate) AS last FROM lineitem) GROUP BY 1, 2, 3)"""

VIEW_NAMES = ["ethereum", "Tron ", "bsc", "OP Mainnet"]


def call_log(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of calls to sources."""
    return table(spark, folder, "events").selectExpr(
        "event_id AS id",
        "element_at(array('cmc', 'messari', 'coingecko', 'defillama'), cast(user_id % 4 AS int) + 1) AS source",
        "ts",
        "event_type <> 'error' AS success",
        "value AS duration",
        "CASE WHEN event_type <> 'error' THEN cast(get_json_object(props, '$.k') AS int) ELSE 0 END AS record_count",
        "CASE WHEN event_type = 'error' THEN element_at(array(401, 404, 429, 500, 503, 0, 400), cast(event_id % 7 AS int) + 1) ELSE 200 END AS status_code",
        "CASE WHEN event_type = 'error' AND event_id % 7 = 5 THEN CASE WHEN event_id % 2 = 0 THEN 'ECONNABORTED' ELSE 'ENOTFOUND' END END AS error_code",
    )


CALL_LOG = """
call_log AS (SELECT event_id AS id, (['cmc', 'messari', 'coingecko', 'defillama'])[(user_id % 4)::INT + 1] AS source, ts, event_type <> 'error' AS success,
  value AS duration, CASE WHEN event_type <> 'error' THEN (props->>'$.k')::INT ELSE 0 END AS record_count,
  CASE WHEN event_type = 'error' THEN ([401, 404, 429, 500, 503, 0, 400])[(event_id % 7)::INT + 1] ELSE 200 END AS status_code,
  CASE WHEN event_type = 'error' AND event_id % 7 = 5 THEN CASE WHEN event_id % 2 = 0 THEN 'ECONNABORTED' ELSE 'ENOTFOUND' END END AS error_code
  FROM events)"""


def asset_text(spark: SparkSession, folder: str) -> DataFrame:
    """Assets with texts and tags of all kinds that the classifier knows, made from the parts."""
    return table(spark, folder, "part").selectExpr(
        "p_partkey AS key",
        "concat(element_at(array('', 'Euro ', 'Canadian Dollar ', 'Gold ', 'NPR ', 'Silver ', 'Real Estate '), cast(p_partkey % 7 AS int) + 1), p_name) AS name",
        "element_at(array('USDT', 'xsgd', 'EUR-token', 'MNEE', 'paxg', 'ZWDt', 'qqqq', 'xag', 'A1', 'try'), cast(p_partkey % 10 AS int) + 1) AS symbol",
        "concat(replace(p_name, ' ', '-'), '-', element_at(array('coin', 'etf', 'stock', 'treasury'), cast(p_partkey % 4 AS int) + 1)) AS slug",
        "array(lower(p_type), element_at(array('stablecoin', 'usd-stablecoin', 'peggedXAU', 'tokenized-assets', 'tokenized-commodities', 'asset-backed-stablecoin', 'tokenized-stock', 'defi', 'Stablecoin'), cast((p_partkey + p_size) % 9 AS int) + 1), "
        "element_at(array('defi', 'asset-backed-stablecoin', 'tokenized-silver', 'misc', 'eur-stablecoin'), cast(p_size % 5 AS int) + 1)) AS tags",
        "element_at(array('cmc', 'messari', 'coingecko', 'defillama'), cast(p_partkey % 4 AS int) + 1) AS source",
    )


ASSET_TEXT = """
asset_text AS (SELECT p_partkey AS key,
  (['', 'Euro ', 'Canadian Dollar ', 'Gold ', 'NPR ', 'Silver ', 'Real Estate '])[(p_partkey % 7)::INT + 1] || p_name AS name,
  (['USDT', 'xsgd', 'EUR-token', 'MNEE', 'paxg', 'ZWDt', 'qqqq', 'xag', 'A1', 'try'])[(p_partkey % 10)::INT + 1] AS symbol,
  replace(p_name, ' ', '-') || '-' || (['coin', 'etf', 'stock', 'treasury'])[(p_partkey % 4)::INT + 1] AS slug,
  [lower(p_type), (['stablecoin', 'usd-stablecoin', 'peggedXAU', 'tokenized-assets', 'tokenized-commodities', 'asset-backed-stablecoin', 'tokenized-stock', 'defi', 'Stablecoin'])[((p_partkey + p_size) % 9)::INT + 1],
   (['defi', 'asset-backed-stablecoin', 'tokenized-silver', 'misc', 'eur-stablecoin'])[(p_size % 5)::INT + 1]] AS tags,
  (['cmc', 'messari', 'coingecko', 'defillama'])[(p_partkey % 4)::INT + 1] AS source FROM part)"""


def with_(*ctes: str, body: str) -> str:
    """The SQL of some common table expressions and a query on them; a body that begins with a comma adds more."""
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body.strip()
