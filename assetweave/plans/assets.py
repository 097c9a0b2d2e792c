"""Queries on alignment and merge of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.functions import taxonomy as tx
from assetweave.functions.exprs import finite
from assetweave.operators import merge, names
from assetweave.operators.filters import market_data_valid, supply_data_valid
from assetweave.operators.views import ranked
from assetweave.plans.bindings import SOURCE_NAMES, SRC_ASSET, asset_platform, chain_history, src_asset, table, with_
from assetweave.registry import query


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return merge.with_asset_key(src_asset(spark, d))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_assets(keyed(spark, d))


def r6(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


KEYED = """
keyed AS (SELECT *, upper(coalesce(nullif(symbol, ''), nullif(slug, ''), nullif(name, ''))) AS asset_key FROM src_asset
          WHERE coalesce(nullif(symbol, ''), nullif(slug, ''), nullif(name, '')) IS NOT NULL)"""


def sql_pick(field: str, source: bool = False) -> str:
    return f"arg_max({'source' if source else field}, prio * 1000 - seq) FILTER (WHERE {field} IS NOT NULL)"


MERGED = (
    "merged0 AS (SELECT asset_key, "
    + ", ".join(f"{sql_pick(f)} AS {f}0" for f in merge.PICKED)
    + ", "
    + ", ".join(f"{sql_pick(f, True)} AS {f}_source" for f in ("price", "mcap", "volume", "circulating"))
    + ", count(price) AS n_price, count(mcap) AS n_mcap, count(circulating) AS n_circulating, list(price) FILTER (WHERE price IS NOT NULL) AS prices,"
    + " median(price) AS med, max(price) AS hi, min(price) AS lo, list_sort(list(DISTINCT source)) AS sources FROM keyed GROUP BY asset_key),\n"
    + """merged1 AS (SELECT asset_key, coalesce(name0, asset_key) AS name, coalesce(upper(symbol0), asset_key) AS symbol, coalesce(slug0, lower(symbol0), lower(asset_key)) AS slug,
  price0 AS price, mcap0 AS mcap, volume0 AS volume, change0 AS change, rank0 AS rank, circulating0 AS circulating, total0 AS total, description0 AS description,
  website0 AS website, date_added0 AS date_added, peg0 AS peg, coalesce(category0, 'Stablecoin') AS category, price_source, mcap_source, volume_source, circulating_source,
  n_price, n_mcap, n_circulating, sources,
  CASE WHEN n_price <= 1 OR med = 0 THEN 0.5::DOUBLE ELSE greatest(0, least(1, 1 - least(1, (greatest(med - lo, hi - med) / greatest(1, med)) / 0.05::DOUBLE))) END AS consensus FROM merged0),
merged2 AS (SELECT *, least(1, 0.5::DOUBLE * (n_price >= 1)::INT + 0.3::DOUBLE * (n_mcap >= 1)::INT + 0.2::DOUBLE * consensus) AS conf_market,
  0.8::DOUBLE * (n_circulating >= 1)::INT + 0.2::DOUBLE * (n_circulating >= 2)::INT AS conf_supply, 0.5::DOUBLE AS conf_platform FROM merged1),
merged AS (SELECT *, least(1, (0.4::DOUBLE * conf_market + 0.4::DOUBLE * conf_supply + 0.1::DOUBLE) * (0.8::DOUBLE + 0.2::DOUBLE * least(1, (n_price + n_mcap + n_circulating) / 6::DOUBLE))) AS conf_overall FROM merged2)"""
)
ASSETS = (SRC_ASSET, KEYED)
ALL = (SRC_ASSET, KEYED, MERGED)

LISTED = ["asset_key", "source", "name", "symbol", "slug", "price", "mcap", "volume", "peg", "category"]


@query("union_sources", with_(SRC_ASSET, body="SELECT key, source, name, round(price, 6) AS price, mcap, volume FROM src_asset"))
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = src_asset(spark, d)
    parts = [rows.where(F.col("source") == s) for s, _ in tx.SOURCES]
    parts[3] = parts[3].drop("volume")  # a source may lack a column
    return merge.union_sources(*parts).select("key", "source", "name", F.round("price", 6).alias("price"), "mcap", "volume")


@query("source_priority_effective", with_(SRC_ASSET, body="SELECT source, CASE WHEN source = 'messari' THEN 12 WHEN source = 'cmc' THEN 10 WHEN source = 'coingecko' THEN 6 ELSE 4 END AS priority, count(*) AS n FROM src_asset GROUP BY ALL"))
def source_priority_effective(spark: SparkSession, d: str) -> DataFrame:
    over = spark.createDataFrame([("messari", 12)], "source string, override int")
    return merge.effective_priority(src_asset(spark, d), over, F.col("prio")).groupBy("source", "priority").agg(F.count(F.lit(1)).alias("n"))


GIVEN = ["price", "mcap", "volume", "rank", "circulating", "total", "description", "website", "date_added"]


@query("source_capabilities", with_(SRC_ASSET, body=f"""
SELECT *, row_number() OVER (PARTITION BY field ORDER BY prio DESC) AS place
FROM ({" UNION ALL ".join(f"SELECT '{f}' AS field, source, max(prio) AS prio, count({f}) AS n FROM src_asset GROUP BY source" for f in GIVEN)}) WHERE n > 0"""))
def source_capabilities(spark: SparkSession, d: str) -> DataFrame:
    return merge.capabilities(src_asset(spark, d), GIVEN)


@query("align_by_symbol", with_(*ASSETS, body="SELECT asset_key, count(*) AS n_entries, count(DISTINCT source) AS n_sources FROM keyed GROUP BY asset_key"))
def align_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).groupBy("asset_key").agg(F.count(F.lit(1)).alias("n_entries"), F.countDistinct("source").alias("n_sources"))


@query("priority_pick", with_(*ASSETS, body="SELECT asset_key, " + ", ".join(f"{sql_pick(f)} AS {f}, {sql_pick(f, True)} AS {f}_source" for f in ("name", "mcap", "volume", "rank", "peg", "category", "website", "date_added")) + " FROM keyed GROUP BY asset_key"))
def priority_pick(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).groupBy("asset_key").agg(*[merge.pick(f, s).alias(f + "_source" * s) for f in ("name", "mcap", "volume", "rank", "peg", "category", "website", "date_added") for s in (False, True)])


MERGE_COLUMNS = ["asset_key", "name", "symbol", "slug", "mcap", "volume", "rank", "peg", "category", "description", "website", "date_added", "price_source", "mcap_source", "volume_source", "circulating_source"]


@query("merge_assets", with_(*ALL, body=f"SELECT {', '.join(MERGE_COLUMNS)}, round(price, 6) AS price, round(circulating, 6) AS circulating, round(total, 6) AS total, round(consensus, 6) AS consensus, round(conf_overall, 6) AS conf_overall, array_to_string(sources, ',') AS sources FROM merged"))
def merge_assets(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select(*MERGE_COLUMNS, *[F.round(c, 6).alias(c) for c in ("price", "circulating", "total", "consensus", "conf_overall")], F.array_join("sources", ",").alias("sources"))


@query("rank_assets", with_(*ALL, body="SELECT asset_key, name, mcap, row_number() OVER (ORDER BY coalesce(mcap, 0) DESC, asset_key) AS rank FROM merged WHERE (name IS NOT NULL OR symbol IS NOT NULL) AND price IS NOT NULL"))
def rank_assets(spark: SparkSession, d: str) -> DataFrame:
    rows = merged(spark, d).where("(name IS NOT NULL OR symbol IS NOT NULL) AND price IS NOT NULL").select("asset_key", "name", "mcap")
    return ranked(rows, F.coalesce("mcap", F.lit(0.0)).desc(), F.col("asset_key"))


@query("union_tags", with_(*ASSETS, body="SELECT asset_key, array_to_string(list_sort(list_distinct(flatten(list(tags)))), '|') AS tags FROM keyed GROUP BY asset_key"))
def union_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = keyed(spark, d).select("asset_key", F.explode("tags").alias("tag"))
    return rows.groupBy("asset_key").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))


@query("available_sources", with_(*ASSETS, body="SELECT asset_key, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM keyed GROUP BY asset_key"))
def available_sources(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).groupBy("asset_key").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("source_price_map", with_(*ASSETS, body="SELECT asset_key, string_agg(source || '=' || round(price * 1000)::BIGINT, ';' ORDER BY source) AS prices FROM keyed WHERE price IS NOT NULL GROUP BY asset_key"))
def source_price_map(spark: SparkSession, d: str) -> DataFrame:
    latest = keyed(spark, d).where(finite("price")).groupBy("asset_key", "source").agg(F.max_by("price", "seq").alias("price"))
    got = latest.groupBy("asset_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "price")))).alias("m"))
    return got.select("asset_key", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("long").cast("string"))), ";").alias("prices"))


@query("consensus_score", with_(*ALL, body="SELECT asset_key, round(consensus, 6) AS consensus FROM merged"))
def consensus_score(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).groupBy("asset_key").agg(F.round(merge.deviation(merge.prices_by_source()), 6).alias("consensus"))


@query("confidence_score", with_(*ALL, body="SELECT asset_key, round(conf_market, 6) AS conf_market, round(conf_supply, 6) AS conf_supply, conf_platform, round(conf_overall, 6) AS conf_overall FROM merged"))
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select("asset_key", *[F.round(c, 6).alias(c) for c in ("conf_market", "conf_supply")], "conf_platform", F.round("conf_overall", 6).alias("conf_overall"))


@query("quality_flags", with_(*ALL, body="SELECT asset_key, array_to_string(list_filter([CASE WHEN price IS NULL THEN 'price' END, CASE WHEN mcap IS NULL THEN 'marketCap' END, CASE WHEN circulating IS NULL THEN 'circulating' END], lambda x: x IS NOT NULL), ',') AS missing, n_price > 0 OR n_mcap > 0 AS has_market, n_circulating > 0 AS has_supply FROM merged"))
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), n) for c, n in (("price", "price"), ("mcap", "marketCap"), ("circulating", "circulating"))]))
    return merged(spark, d).select("asset_key", F.array_join(missing, ",").alias("missing"), ((F.col("n_price") > 0) | (F.col("n_mcap") > 0)).alias("has_market"), (F.col("n_circulating") > 0).alias("has_supply"))


CONFLICTS = """
long AS (SELECT asset_key, source, unnest(['peg', 'category', 'website']) AS field, unnest([peg, category, website]) AS value FROM keyed),
conflicts AS (SELECT asset_key, field, count(*) AS n_entries, list_sort(list(DISTINCT lower(value))) AS dv FROM long WHERE value <> '' GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT lower(value)) > 1)"""
CONFLICT_FIELDS = ["peg", "category", "website"]


@query("field_conflict", with_(*ASSETS, CONFLICTS, body="SELECT asset_key, field, n_entries, len(dv) AS n_distinct, array_to_string(dv, '|') AS distinct_values FROM conflicts"))
def field_conflict(spark: SparkSession, d: str) -> DataFrame:
    return merge.field_conflicts(keyed(spark, d), CONFLICT_FIELDS).select("asset_key", "field", "n_entries", F.size("distinct_values").alias("n_distinct"), F.array_join("distinct_values", "|").alias("distinct_values"))


@query("conflict_counters", with_(*ASSETS, CONFLICTS, body="SELECT coalesce(field, 'all') AS field, coalesce(asset_key, 'all') AS asset_key, count(*) AS n FROM conflicts GROUP BY GROUPING SETS ((), (field), (asset_key))"))
def conflict_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = merge.field_conflicts(keyed(spark, d), CONFLICT_FIELDS)
    got = rows.groupingSets([[], ["field"], ["asset_key"]], "field", "asset_key").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.coalesce("field", F.lit("all")).alias("field"), F.coalesce("asset_key", F.lit("all")).alias("asset_key"), "n")


@query("top_conflicting_assets", with_(*ASSETS, CONFLICTS, body="SELECT asset_key, count(*) AS n FROM conflicts GROUP BY 1 ORDER BY n DESC, asset_key LIMIT 10"))
def top_conflicting_assets(spark: SparkSession, d: str) -> DataFrame:
    return merge.field_conflicts(keyed(spark, d), CONFLICT_FIELDS).groupBy("asset_key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "asset_key").limit(10)


@query("segment_metrics", with_(*ALL, body="SELECT coalesce(category, 'all') AS segment, round(sum(mcap), 2) AS mcap, round(sum(volume), 2) AS volume, count(*) AS n FROM merged GROUP BY GROUPING SETS ((), (category)) HAVING category IS NULL OR category IN ('Stablecoin', 'Tokenized Asset')"))
def segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = merged(spark, d).groupingSets([[], ["category"]], "category").agg(F.round(F.sum("mcap"), 2).alias("mcap"), F.round(F.sum("volume"), 2).alias("volume"), F.count(F.lit(1)).alias("n"))
    return got.select(F.coalesce("category", F.lit("all")).alias("segment"), "mcap", "volume", "n").where(F.col("segment").isin("all", "Stablecoin", "Tokenized Asset"))


@query("market_totals", with_(*ALL, body="SELECT round(sum(coalesce(nullif(mcap, 0), circulating * price)), 2) AS mcap, round(sum(volume), 2) AS volume, count(*) AS n FROM merged WHERE (name IS NOT NULL OR symbol IS NOT NULL) AND price IS NOT NULL"))
def market_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = merged(spark, d).where("(name IS NOT NULL OR symbol IS NOT NULL) AND price IS NOT NULL")
    cap = F.coalesce(F.nullif("mcap", F.lit(0.0)), F.col("circulating") * F.col("price"))
    return rows.agg(F.round(F.sum(cap), 2).alias("mcap"), F.round(F.sum("volume"), 2).alias("volume"), F.count(F.lit(1)).alias("n"))


@query("market_data_valid", with_(*ALL, body="SELECT coalesce(price > 0 AND mcap > 0, false) AS valid, count(*) AS n FROM merged GROUP BY 1"))
def market_valid(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).groupBy(market_data_valid().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("supply_data_valid", with_(*ALL, body="SELECT coalesce(circulating > 0, false) AS valid, count(*) AS n FROM merged GROUP BY 1"))
def supply_valid(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).groupBy(supply_data_valid().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


SPELLED = """
spelled AS (SELECT asset_key, source, CASE WHEN key % 2 = 1 THEN left(name, key % 19) || '~' || substr(name, key % 19 + 2) ELSE name END AS name
  FROM (SELECT p_partkey AS key, 'A' || p_partkey AS asset_key, (['cmc', 'messari', 'coingecko', 'defillama'])[(p_partkey % 4)::INT + 1] AS source, left(md5((p_partkey // 2)::VARCHAR), 18) || ' token' AS name FROM part)),
names AS (SELECT asset_key, min(lower(trim(name))) AS name, list(DISTINCT source) AS sources FROM spelled GROUP BY 1)"""


def spelled(spark: SparkSession, d: str) -> DataFrame:
    """Each part as an asset that one source lists; two parts in turn have one name, which one source misspells."""
    key = F.col("p_partkey")
    name = F.concat(F.left(F.md5(F.floor(key / 2).cast("string")), F.lit(18)), F.lit(" token"))
    source = F.element_at(F.array(*map(F.lit, SOURCE_NAMES)), (key % 4 + 1).cast("int"))
    wrong = F.concat(F.expr("substring(name, 1, cast(p_partkey % 19 AS int))"), F.lit("~"), F.expr("substring(name, cast(p_partkey % 19 + 2 AS int))"))
    rows = table(spark, d, "part").withColumn("name", name)
    return rows.select(F.concat(F.lit("A"), key).alias("asset_key"), source.alias("source"), F.when(key % 2 == 1, wrong).otherwise(F.col("name")).alias("name"))


#: Assets of one name and the same sources, and the links between them.
CLASSES = """
sorted_names AS (SELECT asset_key, name, list_sort(sources) AS sources FROM names WHERE name <> ''),
classes AS (SELECT name, sources, min(asset_key) AS class_key, count(*) AS n FROM sorted_names GROUP BY 1, 2),
links AS (SELECT a.class_key AS left_key, b.class_key AS right_key, a.n AS n_left, b.n AS n_right, 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) AS likeness
  FROM classes a JOIN classes b ON a.class_key < b.class_key AND NOT list_has_any(a.sources, b.sources) WHERE 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) >= 0.8)"""


#: Each listing of each source, and the misspelled names; the names that they have and the links between those.
ENTRIES = """
entries AS (SELECT asset_key || ':' || source AS asset_key, source, name FROM keyed UNION ALL SELECT asset_key, source, name FROM spelled),
entry_names AS (SELECT asset_key, min(lower(trim(name))) AS name, list_sort(list(DISTINCT source)) AS sources FROM entries GROUP BY 1 HAVING min(lower(trim(name))) <> ''),
parts AS (SELECT name, sources, count(*) AS n FROM entry_names GROUP BY 1, 2),
whole AS (SELECT name, min(asset_key) AS key, count(*) AS n FROM entry_names GROUP BY 1),
alike AS (SELECT a.name AS a_name, b.name AS b_name, a.key AS left_key, b.key AS right_key, a.n AS n_left, b.n AS n_right, 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) AS likeness
  FROM whole a JOIN whole b ON a.key < b.key WHERE 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) >= 0.8)"""


@query("align_by_name_similarity", with_(SRC_ASSET, KEYED, SPELLED, ENTRIES, body="""
SELECT 'link' AS kind, left_key, right_key, round(likeness, 6) AS likeness, n_left, n_right, sum(x.n * y.n)::BIGINT AS n_links
FROM alike JOIN parts x ON x.name = a_name JOIN parts y ON y.name = b_name AND NOT list_has_any(x.sources, y.sources) GROUP BY ALL
UNION ALL SELECT 'member', e.asset_key, w.key, 1::DOUBLE, 1::BIGINT, w.n, coalesce((SELECT sum(p.n) FROM parts p WHERE p.name = e.name AND NOT list_has_any(p.sources, e.sources)), 0)::BIGINT
FROM entry_names e JOIN whole w ON w.name = e.name"""))
def align_by_name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Links between names of listings of different sources, and the members of each name."""
    listings = keyed(spark, d).select(F.concat_ws(":", "asset_key", "source").alias("asset_key"), "source", "name")
    return names.aligned_entries(listings.unionByName(spelled(spark, d))).withColumn("likeness", F.round("likeness", 6))


@query("name_classes", with_(SPELLED, CLASSES, body="""
, ends AS (SELECT left_key AS class_key, n_right AS n FROM links UNION ALL SELECT right_key, n_left FROM links)
SELECT asset_key, class_key, coalesce((SELECT sum(e.n) FROM ends e WHERE e.class_key = c.class_key), 0)::BIGINT AS n_links FROM sorted_names s JOIN classes c ON s.name = c.name AND s.sources = c.sources"""))
def name_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.class_members(spelled(spark, d))


NETWORKS = """
networks AS (SELECT 'A' || key AS asset_key, s AS seq, pos, CASE WHEN (key + s) % 2 = 0 THEN platform ELSE lower(platform) END AS network,
  CASE WHEN s = 2 THEN NULL ELSE '0x' || pos % 7 END AS contract, supply FROM asset_platform, (VALUES (0), (1), (2)) t(s))"""


def network_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = asset_platform(spark, d).withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.select(F.concat(F.lit("A"), "key").alias("asset_key"), "seq", "pos", F.when((F.col("key") + F.col("seq")) % 2 == 0, F.col("platform")).otherwise(F.lower("platform")).alias("network"), F.when(F.col("seq") != 2, F.concat(F.lit("0x"), F.col("pos") % 7)).alias("contract"), "supply")


from assetweave.plans.bindings import ASSET_PLATFORM, CHAIN_HISTORY  # noqa: E402


@query("union_networks", with_(ASSET_PLATFORM, NETWORKS, body="SELECT asset_key, seq, pos, network, contract, supply FROM networks QUALIFY row_number() OVER (PARTITION BY asset_key, lower(network), lower(coalesce(contract, '')) ORDER BY seq, pos) = 1"))
def union_networks(spark: SparkSession, d: str) -> DataFrame:
    return merge.union_networks(network_rows(spark, d))


@query("breakdown_override", with_(ASSET_PLATFORM, NETWORKS, CHAIN_HISTORY, body="""
, chains AS (SELECT 'A' || key AS asset_key, chain AS network, current AS supply FROM chain_history WHERE key % 2 = 0),
nets AS (SELECT asset_key, network, supply FROM networks QUALIFY row_number() OVER (PARTITION BY asset_key, lower(network), lower(coalesce(contract, '')) ORDER BY seq, pos) = 1),
assets AS (SELECT DISTINCT 'A' || l_partkey AS asset_key FROM lineitem)
SELECT asset_key, network, supply FROM assets JOIN chains USING (asset_key)
UNION ALL SELECT asset_key, network, supply FROM assets JOIN nets USING (asset_key) WHERE asset_key NOT IN (SELECT asset_key FROM chains)"""))
def breakdown_override(spark: SparkSession, d: str) -> DataFrame:
    chains = chain_history(spark, d).where("key % 2 = 0").select(F.concat(F.lit("A"), "key").alias("asset_key"), F.col("chain").alias("network"), F.col("current").alias("supply"))
    nets = merge.union_networks(network_rows(spark, d)).select("asset_key", "network", "supply")
    assets = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("A"), "l_partkey").alias("asset_key")).distinct()
    return merge.breakdown_override(assets, chains, nets)
