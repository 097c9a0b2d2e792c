"""Streaming jobs run to the end of the tables that are there, and their results as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.operators import classify as cl
from assetweave.operators import merge
from assetweave.operators.health import error_type
from assetweave.plans.bindings import CALL_LOG, SOURCE_NAMES, SRC_ASSET, call_log, src_asset, with_
from assetweave.plans.classes import RAW, VIOLATIONS, raw_json
from assetweave.plans.log import KIND, _breaker
from assetweave.plans.snapshots import folder
from assetweave.registry import query
from assetweave.sources.versions import KeyedTable
from assetweave.streaming import jobs


#: The spans of the stateful streams, as their calls are minutes apart.
HOUR_MS = 3_600_000
#: Calls of a landed file, about.
FILE_ROWS = 1_000_000


def landed_log(spark: SparkSession, d: str, pieces: int = 3) -> DataFrame:
    """The call log as it lands, piece by piece in time, each piece in files of bounded size that make a trigger."""
    path = folder(spark, "calls")
    log = call_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    number = F.unix_micros("ts")
    n, cuts = log.agg(F.count(F.lit(1)), F.percentile_approx(number, F.array(*[F.lit(k / pieces) for k in range(1, pieces)]))).first()
    cuts, files = cuts or [], max(1, -(-n // (pieces * FILE_ROWS)))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = log if low is None else log.where(number >= low)
        (part if high is None else part.where(number < high)).repartition(files).write.mode("append").parquet(path)
    return jobs.read_stream(spark, path, log.schema, files=files)


def result(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    target = folder(spark, "published")
    jobs.publish(stream, target, folder(spark, "progress"), mode).awaitTermination()
    return spark.read.parquet(target).drop("batch")


WINDOWS = "generate_series(time_bucket(INTERVAL '{0} minutes', ts - INTERVAL 1 HOUR) + INTERVAL '{0} minutes', time_bucket(INTERVAL '{0} minutes', ts), INTERVAL '{0} minutes')"


@query("stream_latency_1h", with_(CALL_LOG, body=f"SELECT source, start, count(*) AS n, count(*) FILTER (WHERE NOT success) AS errors, round(sum(duration), 4) AS total_ms, max(duration) AS most_ms, quantile_disc(CASE WHEN duration > 0 THEN duration END, 0.5) AS median, quantile_disc(CASE WHEN duration > 0 THEN duration END, 0.95) AS p95, quantile_disc(CASE WHEN duration > 0 THEN duration END, 0.99) AS p99 FROM (SELECT *, unnest({WINDOWS.format(5)}) AS start FROM call_log) GROUP BY source, start"))
def stream_latency_1h(spark: SparkSession, d: str) -> DataFrame:
    got = result(spark, jobs.stream_latency_1h(landed_log(spark, d)), "complete")
    return got.withColumns({"total_ms": F.round("total_ms", 4), "start": F.col("start").cast("timestamp_ntz")})


@query("stream_conflict_rate", with_(CALL_LOG, body=f"SELECT start, count(*) AS n FROM (SELECT unnest({WINDOWS.format(15)}) AS start FROM call_log WHERE NOT success) GROUP BY start"))
def stream_conflict_rate(spark: SparkSession, d: str) -> DataFrame:
    return result(spark, jobs.stream_conflict_rate(landed_log(spark, d)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: All calls of each source folded one by one, and what their scores are made of; hours that the watermark has passed.
FOLD = (
    _breaker(3).split("breaker AS")[0].rstrip().rstrip(",").replace(" WHERE ts > (SELECT max(ts) FROM call_log) - INTERVAL 168 HOUR", "")
    + """,
mark AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM call_log),
stats AS (SELECT source, k, ts, epoch_ms(ts) // 3600000 AS span, sum((NOT success)::INT) OVER w AS errors, k - coalesce(max(CASE WHEN success THEN k END) OVER w, 0) AS streak, avg(CASE WHEN duration > 0 THEN duration END) OVER w AS mean_ms FROM calls WINDOW w AS (PARTITION BY source ORDER BY k)),
steps AS (SELECT s.*, f.state, lag(f.state, 1, 'closed') OVER (PARTITION BY f.source ORDER BY f.k) AS from_state, f.failures, f.opened, 100 - 50 * (errors / s.k::DOUBLE) - least(40, 10 * streak) - CASE WHEN mean_ms > 10000 THEN 20 ELSE 0 END AS raw,
  row_number() OVER (PARTITION BY s.source, span ORDER BY s.k DESC) AS back FROM fold f JOIN stats s ON s.source = f.source AND s.k = f.k),
scored AS (SELECT *, round(greatest(0, least(100, CASE state WHEN 'open' THEN 0 WHEN 'half-open' THEN raw * 0.5::DOUBLE ELSE raw END)), 6) AS score FROM steps WHERE (span + 1) * 3600000 <= (SELECT mark FROM mark))"""
)


@query("stream_breaker", with_(CALL_LOG, FOLD, body="""
SELECT source, ts, from_state, state, failures, opened, score FROM scored WHERE from_state <> state
UNION ALL SELECT source, make_timestamp((span + 1) * 3600000000), NULL, state, failures, opened, score FROM scored WHERE back = 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def stream_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the breakers, and each source's breaker and score at the end of each hour with calls."""
    got = result(spark, jobs.stream_breaker(landed_log(spark, d), threshold=3, span_ms=HOUR_MS), "append")
    return got.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "score": F.round("score", 6)})


_RANK = "CASE {0} WHEN 'critical' THEN 3 WHEN 'error' THEN 2 WHEN 'warning' THEN 1 WHEN 'info' THEN 0 END"
#: Each key's alerts one by one: the alert that is open and its time, and what each event does to it. An event may both end
#: an alert that is too old and open one.
ALERT_EVENTS = f"""
mark AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM call_log),
raised AS (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY ts, id) AS k FROM (
  SELECT source, CASE WHEN success THEN 'server' ELSE {KIND} END AS type, CASE WHEN success THEN NULL WHEN duration > 100 THEN 'critical' WHEN duration > 50 THEN 'error' WHEN duration > 10 THEN 'warning' ELSE 'info' END AS level, ts, id FROM call_log WHERE (epoch_ms(ts) // 3600000 + 1) * 3600000 <= (SELECT mark FROM mark))),
walk AS (SELECT source, type, 0::BIGINT AS k, NULL::VARCHAR AS open_level, NULL::TIMESTAMP AS since, NULL::VARCHAR AS old_level, NULL::TIMESTAMP AS old_since, NULL::VARCHAR AS event, NULL::VARCHAR AS event_level, NULL::TIMESTAMP AS ts FROM (SELECT DISTINCT source, type FROM raised)
  UNION ALL
  SELECT source, type, k, CASE WHEN level IS NULL THEN NULL WHEN event IN ('opened', 'upgraded') THEN level ELSE live END, CASE WHEN level IS NULL THEN NULL WHEN event IN ('opened', 'upgraded') THEN ts ELSE since END,
    CASE WHEN gone THEN open_level END, CASE WHEN gone THEN since END, event, CASE WHEN event = 'resolved' THEN live ELSE level END, ts
  FROM (SELECT *, CASE WHEN level IS NULL AND live IS NOT NULL THEN 'resolved' WHEN level IS NULL THEN NULL WHEN live IS NULL THEN 'opened' WHEN {_RANK.format("level")} > {_RANK.format("live")} THEN 'upgraded' END AS event
    FROM (SELECT r.source, r.type, r.k, r.level, r.ts, w.open_level, w.since, coalesce(w.since + INTERVAL 7 DAY <= r.ts, false) AS gone, CASE WHEN w.since + INTERVAL 7 DAY <= r.ts THEN NULL ELSE w.open_level END AS live
      FROM walk w JOIN raised r ON r.source = w.source AND r.type = w.type AND r.k = w.k + 1)))"""


@query("stream_alerts", with_(CALL_LOG, ALERT_EVENTS, body="""
SELECT source, type, event, event_level AS level, ts FROM walk WHERE event IS NOT NULL
UNION ALL SELECT source, type, 'expired', old_level, old_since FROM walk WHERE old_level IS NOT NULL
UNION ALL SELECT source, type, 'expired', open_level, since FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY source, type ORDER BY k DESC) = 1) WHERE open_level IS NOT NULL AND epoch_us(since + INTERVAL 7 DAY) // 1000 < (SELECT mark FROM mark)""").replace("WITH ", "WITH RECURSIVE ", 1))
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("success"), F.lit(None)).when(F.col("duration") > 100, "critical").when(F.col("duration") > 50, "error").when(F.col("duration") > 10, "warning").otherwise("info")
    kind = F.when(F.col("success"), "server").otherwise(error_type())
    alerts = landed_log(spark, d).select("source", kind.alias("type"), level.alias("level"), "ts", "id").withWatermark("ts", jobs.LATENESS)
    return result(spark, jobs.stream_alerts(alerts, span_ms=HOUR_MS), "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_refresh", with_(SRC_ASSET, body="SELECT upper(coalesce(symbol, slug, name)) AS asset_key, arg_max(mcap, prio * 1000 - seq) AS mcap, count(*) AS n_sources FROM src_asset GROUP BY 1"))
def stream_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Sources that land one after another, each a trigger of its own; the last version has all of them."""
    path = folder(spark, "snapshots")
    rows = merge.with_asset_key(src_asset(spark, d))
    for seq in range(len(SOURCE_NAMES)):
        rows.where(F.col("seq") == seq).coalesce(1).write.mode("append").parquet(path)
    one = lambda x: x.groupBy("asset_key").agg(merge.pick("mcap").alias("mcap"), F.count(F.lit(1)).alias("n_sources"))
    # one asset has several rows of a source where keys share a symbol
    table = KeyedTable(spark, folder(spark, "assets"), "asset_key", "listing", one, buckets=16)
    stream = jobs.read_stream(spark, path, rows.schema, files=1).withColumn("listing", F.concat_ws(":", "source", "key"))
    jobs.stream_refresh(stream, table, folder(spark, "progress"), {"availableNow": True}).awaitTermination()
    return table.derived().select("asset_key", "mcap", "n_sources")


@query("stream_schema_drift", with_(RAW, VIOLATIONS, body="SELECT source, id, field, violation FROM violations"))
def stream_schema_drift(spark: SparkSession, d: str) -> DataFrame:
    path, target = folder(spark, "payloads"), folder(spark, "drift")
    raw = raw_json(spark, d)
    raw.write.parquet(path)
    jobs.stream_schema_drift(jobs.read_stream(spark, path, raw.schema), cl.schema_violations, target, folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).drop("batch")


