"""Queries of the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.functions import taxonomy as tx
from assetweave.operators import classify as cl
from assetweave.operators.filters import fiat_backed
from assetweave.operators.ordered import spread
from assetweave.plans.bindings import ASSET_TEXT, SRC_ASSET, asset_text, src_asset, table, with_
from assetweave.registry import query

_ISO = "(" + ", ".join(f"'{c}'" for c in tx.ISO_CODES) + ")"
_ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.CURRENCY_ALIASES.items()) + "}"


def _alias(x: str) -> str:
    return f"coalesce(({_ALIAS})[{x}], {x})"


def _known(x: str) -> str:
    return f"CASE WHEN upper({x}) IN {_ISO} THEN {_alias(f'upper({x})')} END"


def _part(x: str, p: str) -> str:
    return f"nullif(regexp_extract({x}, '{p}', 1), '')"


CURRENCY = (
    f"coalesce(({_ALIAS})[upper(sy)], {_known(_part('sy', '^([a-z]{3})(?:[tc]|[-_](?:token|coin|t))?$'))}, "
    + ", ".join(f"CASE WHEN regexp_matches(na, '\\b(?:{p})\\b') OR regexp_matches(sl, '\\b(?:{p})\\b') THEN {_alias(repr(c))} END" for c, p in tx.CURRENCY_NAMES)
    + f", {_known('coalesce(' + _part('sy', '^([a-z]{3})[tc]?$') + ', ' + _part('sy', '^([a-z]{3})[-_]') + ')')}, {_known(_part('sy', '^x([a-z]{3})$'))}, {_known(_part('wo', '([a-z]{3})'))})"
)
METAL = "CASE WHEN regexp_matches(sy, 'xau|paxg|xaut') OR contains(na, 'gold') OR contains(sl, 'gold') THEN 'Gold' WHEN contains(sy, 'xag') OR contains(na, 'silver') OR contains(sl, 'silver') THEN 'Silver' END"
CATEGORY = "CASE WHEN list_contains(tg, 'stablecoin') OR len(list_filter(tg, lambda t: regexp_matches(t, '^([a-z]{3}-stablecoin|pegged[a-z0-9]+)$'))) > 0 THEN 'Stablecoin' WHEN len(list_intersect(tg, ['tokenized-assets', " + ", ".join(f"'{t}'" for t, _ in tx.TOKENIZED_SUBTYPES) + "])) > 0 THEN 'Tokenized Asset' ELSE 'Other' END"
CLASSED = f"""
low AS (SELECT *, list_transform(tags, lambda t: lower(t)) AS tg, lower(name) AS na, lower(symbol) AS sy, lower(slug) AS sl,
  list_filter(string_split_regex(lower(name) || ' ' || lower(slug), '[^a-z0-9_]+'), lambda w: regexp_matches(w, '^[a-z]{{3}}$'))[1] AS wo FROM asset_text),
c1 AS (SELECT *, {CATEGORY} AS category, {CURRENCY} AS cur, {METAL} AS metal FROM low),
c2 AS (SELECT *, coalesce(metal, CASE WHEN contains(na, 'etf') OR contains(sl, 'etf') THEN 'ETF' WHEN contains(na, 'treasury') OR contains(sl, 'treasury') THEN 'Treasury Bills' WHEN contains(na, 'stock') OR contains(sl, 'stock') THEN 'Stocks' WHEN contains(na, 'estate') OR contains(sl, 'estate') THEN 'Real Estate' END, 'Tokenized Asset') AS tok,
  list_filter(list_transform(tg, lambda t: upper(regexp_extract(t, '^([a-z]{{3}})-stablecoin$', 1))), lambda c: c <> '')[1] AS t1,
  list_filter(list_transform(tg, lambda t: upper(regexp_extract(t, '^pegged([a-z0-9]+)$', 1))), lambda c: c <> '')[1] AS t2,
  CASE WHEN list_contains(tg, 'tokenized-gold') THEN 'Gold' WHEN metal = 'Gold' THEN 'Gold' WHEN list_contains(tg, 'tokenized-silver') THEN 'Silver' ELSE coalesce(metal, 'Commodities') END AS com FROM c1),
c3 AS (SELECT *, coalesce(cur, nullif(tok, 'Tokenized Asset')) AS backed, list_contains(tg, 'asset-backed-stablecoin') AS is_backed FROM c2),
classed AS (SELECT *, CASE WHEN category = 'Stablecoin' THEN coalesce({_alias('t1')}, {_alias('t2')}, cur, CASE WHEN is_backed THEN backed END)
  ELSE coalesce({', '.join(f"CASE WHEN list_contains(tg, '{t}') THEN {'com' if v == 'Commodities' else repr(v)} END" for t, v in tx.TOKENIZED_SUBTYPES)}, CASE WHEN list_contains(tg, 'tokenized-assets') THEN tok END, CASE WHEN is_backed THEN backed END) END AS peg FROM c3)"""
C = (ASSET_TEXT, CLASSED)


def classed(spark: SparkSession, d: str) -> DataFrame:
    return cl.classify(spread(asset_text(spark, d))).withColumnRenamed("peg_found", "peg")


def lowered(spark: SparkSession, d: str) -> DataFrame:
    return asset_text(spark, d).select("key", F.transform("tags", F.lower).alias("tags"), F.lower("symbol").alias("symbol"), F.lower("name").alias("name"), F.lower("slug").alias("slug"))


T = cl.Taxonomy()


@query("classify_category", with_(*C, body="SELECT key, category FROM classed"))
def classify_category(spark: SparkSession, d: str) -> DataFrame:
    return lowered(spark, d).select("key", T.category(F.col("tags")).alias("category"))


@query("classify_peg", with_(*C, body="SELECT key, category, peg FROM classed"))
def classify_peg(spark: SparkSession, d: str) -> DataFrame:
    return classed(spark, d).select("key", "category", "peg")


@query("detect_currency", with_(*C, body="SELECT key, cur AS currency FROM classed"))
def detect_currency(spark: SparkSession, d: str) -> DataFrame:
    return lowered(spark, d).select("key", T.currency(F.col("symbol"), F.col("name"), F.col("slug")).alias("currency"))


@query("infer_commodity", with_(*C, body="SELECT key, com AS commodity FROM classed"))
def infer_commodity(spark: SparkSession, d: str) -> DataFrame:
    return lowered(spark, d).select("key", T.commodity(F.col("tags"), F.col("symbol"), F.col("name"), F.col("slug")).alias("commodity"))


@query("infer_tokenized_type", with_(*C, body="SELECT key, tok AS kind FROM classed"))
def infer_tokenized_type(spark: SparkSession, d: str) -> DataFrame:
    return lowered(spark, d).select("key", T.tokenized_type(F.col("symbol"), F.col("name"), F.col("slug")).alias("kind"))


@query("infer_asset_backed", with_(*C, body="SELECT key, backed FROM classed"))
def infer_asset_backed(spark: SparkSession, d: str) -> DataFrame:
    return lowered(spark, d).select("key", T.asset_backed(F.col("symbol"), F.col("name"), F.col("slug")).alias("backed"))


@query("taxonomy_custom", with_(ASSET_TEXT, body="SELECT key, CASE WHEN len(list_filter(tags, lambda t: lower(t) IN ('stablecoin', 'misc') OR regexp_matches(lower(t), '^([a-z]{3}-stablecoin|pegged[a-z0-9]+)$'))) > 0 THEN 'Stablecoin' WHEN len(list_filter(tags, lambda t: starts_with(lower(t), 'tokenized-') OR lower(t) = 'defi')) > 0 THEN 'Tokenized Asset' ELSE 'Other' END AS category FROM asset_text"))
def taxonomy_custom(spark: SparkSession, d: str) -> DataFrame:
    custom = cl.Taxonomy(stable_tags=["misc"], tokenized_tags=["DeFi"], currencies={"ZZZ": "zedd"})
    return cl.classify(asset_text(spark, d), custom).select("key", "category")


@query("classify_input_check", with_(ASSET_TEXT, body="SELECT valid, count(*) AS n FROM (SELECT key % 50 <> 0 AND key % 49 <> 0 AS valid FROM asset_text) GROUP BY valid"))
def classify_input_check(spark: SparkSession, d: str) -> DataFrame:
    rows = asset_text(spark, d).withColumn("name", F.when(F.col("key") % 50 == 0, F.repeat("name", 200)).otherwise(F.col("name"))).withColumn("tags", F.when(F.col("key") % 49 != 0, F.col("tags")))
    return rows.groupBy(cl.input_valid().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("classification_stats", with_(*C, body="SELECT 'all' AS \"by\", 'all' AS value, count(*) AS n FROM classed UNION ALL SELECT 'source', source, count(*) FROM classed GROUP BY source UNION ALL SELECT 'category', category, count(*) FROM classed GROUP BY category"))
def classification_stats(spark: SparkSession, d: str) -> DataFrame:
    return cl.stats(classed(spark, d))


@query("unknown_tag_patterns", with_(*C, body="SELECT array_to_string(list_sort(tags[1:5]), '|') AS pattern, count(*) AS n FROM classed WHERE category = 'Other' AND len(tags) > 0 GROUP BY 1"))
def unknown_tag_patterns(spark: SparkSession, d: str) -> DataFrame:
    return cl.unknown_patterns(classed(spark, d))


ENTRIES = "entries AS (SELECT 'A' || key AS asset_key, source, seq, category, CASE WHEN key % 13 = 0 THEN NULL ELSE lower(peg) END AS peg, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * ((key * 7 + seq * 5) % 24) AS ts FROM src_asset)"
E = (SRC_ASSET, ENTRIES)


def entries(spark: SparkSession, d: str) -> DataFrame:
    ts = F.timestamp_millis(F.lit(1704067200000) + (F.col("key") * 7 + F.col("seq") * 5) % 24 * 3600000)
    return src_asset(spark, d).select(F.concat(F.lit("A"), "key").alias("asset_key"), "source", "seq", "category", F.when(F.col("key") % 13 != 0, F.lower("peg")).alias("peg"), ts.alias("ts"))


CONF = """
newest AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY asset_key ORDER BY ts DESC, seq) <= 5),
conf AS (SELECT asset_key, n_sources, CASE WHEN c > 1 AND p > 1 THEN 'mixed' WHEN c > 1 THEN 'category' WHEN p > 1 THEN 'peggedAsset' END AS conflict
  FROM (SELECT asset_key, count(*) AS n_sources, count(DISTINCT category) AS c, count(DISTINCT coalesce(peg, 'none')) AS p FROM newest GROUP BY 1))"""


@query("classification_conflict", with_(*E, CONF, body="SELECT asset_key, n_sources, conflict FROM conf WHERE conflict IS NOT NULL"))
def classification_conflict(spark: SparkSession, d: str) -> DataFrame:
    return cl.class_conflicts(entries(spark, d)).select("asset_key", "n_sources", "conflict")


@query("conflict_summary", with_(*E, CONF, body="SELECT count(*) AS n_assets, count(conflict) AS n_conflicted, round(count(conflict)::DOUBLE / count(*), 6) AS rate, count(*) FILTER (WHERE conflict = 'category') AS by_category, count(*) FILTER (WHERE conflict = 'peggedAsset') AS by_peg, count(*) FILTER (WHERE conflict = 'mixed') AS by_both FROM conf"))
def conflict_summary(spark: SparkSession, d: str) -> DataFrame:
    keys = entries(spark, d).select("asset_key").distinct().join(cl.class_conflicts(entries(spark, d)).select("asset_key", "conflict"), "asset_key", "left")
    of = lambda k: F.count_if(F.col("conflict") == k)
    return keys.agg(F.count(F.lit(1)).alias("n_assets"), F.count("conflict").alias("n_conflicted"), F.round(F.count("conflict") / F.count(F.lit(1)), 6).alias("rate"), of("category").alias("by_category"), of("peggedAsset").alias("by_peg"), of("mixed").alias("by_both"))


def _resolve(rank: str) -> str:
    return with_(*E, body=f"SELECT asset_key, category, peg FROM entries QUALIFY row_number() OVER (PARTITION BY asset_key ORDER BY {rank} DESC, seq) = 1")


@query("resolve_priority", _resolve("CASE source WHEN 'cmc' THEN 10 WHEN 'messari' THEN 9 WHEN 'defillama' THEN 8 ELSE 6 END"))
def resolve_priority(spark: SparkSession, d: str) -> DataFrame:
    return cl.resolved(entries(spark, d), "priority")


@query("resolve_most_specific", _resolve("CASE WHEN category = 'Other' THEN 1 ELSE 2 END + (peg IS NOT NULL)::INT"))
def resolve_most_specific(spark: SparkSession, d: str) -> DataFrame:
    return cl.resolved(entries(spark, d), "specific")


@query("resolve_newest", _resolve("ts"))
def resolve_newest(spark: SparkSession, d: str) -> DataFrame:
    return cl.resolved(entries(spark, d), "newest")


@query("resolve_consensus", with_(*E, body="""
, vc AS (SELECT asset_key, category AS v, count(*) AS n, min(seq) AS f FROM entries GROUP BY 1, 2), vp AS (SELECT asset_key, coalesce(peg, 'none') AS v, count(*) AS n, min(seq) AS f FROM entries GROUP BY 1, 2)
SELECT asset_key, c.v AS category, nullif(p.v, 'none') AS peg FROM (SELECT * FROM vc QUALIFY row_number() OVER (PARTITION BY asset_key ORDER BY n DESC, f DESC) = 1) c JOIN (SELECT * FROM vp QUALIFY row_number() OVER (PARTITION BY asset_key ORDER BY n DESC, f DESC) = 1) p USING (asset_key)"""))
def resolve_consensus(spark: SparkSession, d: str) -> DataFrame:
    return cl.resolved_by_consensus(entries(spark, d))


RAW = """
raw AS (SELECT source, id, field, type FROM (SELECT (['cmc', 'messari', 'coingecko', 'defillama'])[(p_partkey % 4)::INT + 1] AS source, p_partkey AS id,
  [{'f': 'symbol', 't': 'string'}, {'f': CASE WHEN p_partkey % 10 <> 0 THEN 'name' ELSE 'title' END, 't': 'string'}, {'f': 'id', 't': CASE WHEN p_partkey % 3 = 0 THEN 'string' ELSE 'number' END},
   {'f': 'tags', 't': CASE WHEN p_size % 7 = 0 THEN 'string' ELSE 'array' END}, {'f': CASE WHEN p_size % 11 = 0 THEN 'surprise' ELSE 'metadata' END, 't': 'object'}] AS fs FROM part) x, unnest(fs) u(s), (SELECT 1) z, LATERAL (SELECT s.f AS field, s.t AS type))"""


def raw_json(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    kv = lambda name, value: F.concat(F.lit('"'), name, F.lit('": '), value)
    fields = [kv(F.lit("symbol"), F.lit('"S"')), kv(F.when(k % 10 != 0, "name").otherwise("title"), F.concat(F.lit('"'), "p_name", F.lit('"'))), kv(F.lit("id"), F.when(k % 3 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k.cast("string"))), kv(F.lit("tags"), F.when(size % 7 == 0, F.lit('"x"')).otherwise(F.lit('["x"]'))), kv(F.when(size % 11 == 0, "surprise").otherwise("metadata"), F.lit('{"a": 1}'))]
    return p.select(F.get(F.array(*[F.lit(s) for s, _ in tx.SOURCES]), F.lit(0)).alias("_"), k.alias("id"), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")).alias("payload")).withColumn("source", F.get(F.array(F.lit("cmc"), F.lit("messari"), F.lit("coingecko"), F.lit("defillama")), (F.col("id") % 4).cast("int"))).select("source", "id", "payload")


_EXPECTED = ", ".join(f"('{s}', '{f}', {str(f in x['required']).lower()}, {repr(x['types'][f]) if f in x['types'] else 'NULL'})" for s, x in tx.EXPECTED_FIELDS.items() for f in dict.fromkeys([*x["required"], *x["optional"], *x["types"]]))
VIOLATIONS = f"""
expected(source, field, required, type) AS (VALUES {_EXPECTED}),
ids AS (SELECT DISTINCT source, id FROM raw),
violations AS (SELECT i.source, i.id, e.field, 'missing' AS violation FROM ids i JOIN expected e ON e.source = i.source AND e.required WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.source = i.source AND r.id = i.id AND r.field = e.field)
  UNION ALL SELECT r.source, r.id, r.field, 'type' FROM raw r JOIN expected e USING (source, field) WHERE e.type IS NOT NULL AND e.type <> r.type
  UNION ALL SELECT r.source, r.id, r.field, 'unknown' FROM raw r WHERE (r.source, r.field) NOT IN (SELECT (source, field) FROM expected))"""


@query("schema_violations", with_(RAW, VIOLATIONS, body="SELECT source, id, field, violation FROM violations"))
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    return cl.schema_violations(raw_json(spark, d))


@query("schema_profile", with_(RAW, body="SELECT source, field, type, count(*) AS n FROM raw GROUP BY ALL"))
def schema_profile(spark: SparkSession, d: str) -> DataFrame:
    return cl.schema_profile(raw_json(spark, d))


def violation_log(spark: SparkSession, d: str) -> DataFrame:
    ts = F.timestamp_millis(F.lit(1704067200000) + F.col("id") * 60000)
    return cl.schema_violations(raw_json(spark, d)).withColumn("ts", ts)


EVENTS = """
drifted AS (SELECT source, id, count(*) FILTER (WHERE violation <> 'unknown') AS n_violations, count(*) FILTER (WHERE violation = 'unknown') AS n_unknown, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE violation = 'unknown'), '') AS attributes FROM violations GROUP BY source, id)"""


@query("schema_drift_log", with_(RAW, VIOLATIONS, EVENTS, body="""
SELECT 'violations' AS list, * FROM drifted WHERE n_violations > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY id DESC) <= 100
UNION ALL SELECT 'drift', * FROM drifted QUALIFY row_number() OVER (PARTITION BY source ORDER BY id DESC) <= 25"""))
def schema_drift_log(spark: SparkSession, d: str) -> DataFrame:
    return cl.drift_log(violation_log(spark, d)).select("list", "source", "id", "n_violations", "n_unknown", F.array_join("attributes", ",").alias("attributes"))


DRIFT = """
drift0 AS (SELECT source, count(*) FILTER (WHERE id > (SELECT max(id) FROM violations) - 1440 AND violation <> 'unknown') AS n_violations, count(DISTINCT CASE WHEN violation = 'unknown' THEN field END) AS n_unknown FROM violations GROUP BY source),
drift AS (SELECT *, CASE WHEN sum(n_violations) OVER () > 50 OR sum(n_unknown) OVER () > 20 THEN 'critical' WHEN sum(n_violations) OVER () > 10 OR sum(n_unknown) OVER () > 5 THEN 'degraded' ELSE 'healthy' END AS status FROM drift0)"""


@query("schema_drift_status", with_(RAW, VIOLATIONS, DRIFT, body="SELECT * FROM drift"))
def schema_drift_status(spark: SparkSession, d: str) -> DataFrame:
    return cl.drift_status(violation_log(spark, d))


SUMMARY = """
summary AS (SELECT (SELECT avg((category <> 'Other')::INT::DOUBLE) FROM classed) AS success_rate, (SELECT count(conflict)::DOUBLE / count(*) FROM conf) AS conflict_rate,
  (SELECT count(DISTINCT array_to_string(list_sort(tags[1:5]), '|')) FROM classed WHERE category = 'Other') AS n_unknown, (SELECT max(status) FROM drift) AS schema)"""
ALL_SUMMARY = (*C, *E, CONF, RAW, VIOLATIONS, DRIFT, SUMMARY)


def summary(spark: SparkSession, d: str) -> DataFrame:
    ok = classed(spark, d).agg(F.avg(F.when(F.col("category") != "Other", 1.0).otherwise(0.0)).alias("success_rate"))
    rate = conflict_rate(spark, d)
    unknown = cl.unknown_patterns(classed(spark, d)).agg(F.count(F.lit(1)).alias("n_unknown"))
    schema = cl.drift_status(violation_log(spark, d)).agg(F.max("status").alias("schema"))
    return ok.join(F.broadcast(rate)).join(F.broadcast(unknown)).join(F.broadcast(schema))


def conflict_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(spark, d)
    keys = rows.select("asset_key").distinct().join(cl.class_conflicts(rows).select("asset_key", "conflict"), "asset_key", "left")
    return keys.agg((F.count("conflict") / F.count(F.lit(1))).alias("conflict_rate"))


@query("classifier_alerts", with_(*ALL_SUMMARY, body="""
SELECT 'success_rate' AS type, CASE WHEN success_rate < 0.5 THEN 'critical' ELSE 'warning' END AS level, round(success_rate, 6) AS value FROM summary WHERE success_rate < 0.8
UNION ALL SELECT 'unknown_patterns', 'warning', n_unknown::DOUBLE FROM summary WHERE n_unknown > 20
UNION ALL SELECT 'conflict_rate', CASE WHEN conflict_rate > 0.3 THEN 'critical' ELSE 'warning' END, round(conflict_rate, 6) FROM summary WHERE conflict_rate > 0.1"""))
def classifier_alerts(spark: SparkSession, d: str) -> DataFrame:
    return cl.classifier_alerts(summary(spark, d))


@query("data_quality_health", with_(*ALL_SUMMARY, body="""
SELECT score, CASE WHEN score < 50 THEN 'critical' WHEN score < 75 THEN 'degraded' ELSE 'healthy' END AS status,
  CASE WHEN conflict_rate > 0.3 OR schema = 'critical' OR n_unknown > 50 THEN 'critical' WHEN conflict_rate > 0.1 OR schema = 'degraded' OR n_unknown > 20 THEN 'degraded' ELSE 'healthy' END AS quality
FROM (SELECT *, greatest(0, floor(100 - 40 * (1 - success_rate) - 30 * conflict_rate - CASE schema WHEN 'critical' THEN 25 WHEN 'degraded' THEN 10 ELSE 0 END + 0.5)) AS score FROM summary)"""))
def data_quality_health(spark: SparkSession, d: str) -> DataFrame:
    return cl.quality_health(summary(spark, d)).select("score", "status", "quality")


@query("fiat_only", with_(*C, body=f"SELECT key, peg FROM classed WHERE peg IS NULL OR trim(peg) = '' OR upper(trim(peg)) IN {_ISO} OR coalesce(({_ALIAS})[upper(trim(peg))] IN {_ISO}, false)"))
def fiat_only(spark: SparkSession, d: str) -> DataFrame:
    return classed(spark, d).where(fiat_backed(F.col("peg"))).select("key", "peg")


@query("normalize_peg_type", "SELECT p_partkey AS key, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'Gold' WHEN p_size % 5 = 2 THEN 'Silver' WHEN p_size % 5 = 3 THEN 'USD' ELSE NULL END AS peg FROM part")
def normalize_peg_type(spark: SparkSession, d: str) -> DataFrame:
    from assetweave.operators.standardize import peg_of_type

    raw = F.get(F.array(F.lit(None).cast("string"), F.lit("peggedXAU"), F.lit("peggedXAG"), F.lit("peggedUSD"), F.lit("floating")), (F.col("p_size") % 5).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), peg_of_type(raw).alias("peg"))


