"""Queries on the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.operators import health as h
from assetweave.operators import merge
from assetweave.operators.ordered import in_pieces, running
from assetweave.operators.ordered import shared_path as folder
from assetweave.plans.assets import ASSETS, CONFLICTS, keyed
from assetweave.plans.bindings import CALL_LOG, call_log, with_
from assetweave.registry import query
from assetweave.sources.versions import newest

HOURS = 24.0
L = (CALL_LOG,)
RECENT = "recent AS (SELECT * FROM call_log WHERE ts > (SELECT max(ts) FROM call_log) - INTERVAL 24 HOUR)"


@query("latency_stats", with_(*L, RECENT, body="""
, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY duration, id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM recent WHERE duration > 0)
SELECT source, count(*) AS n, round(avg(duration), 6) AS mean, round(median(duration), 6) AS median, max(duration) FILTER (WHERE r = ceil(0.95::DOUBLE * (n - 1))) AS p95, max(duration) FILTER (WHERE r = ceil(0.99::DOUBLE * (n - 1))) AS p99, min(duration) AS least, max(duration) AS most FROM p GROUP BY source"""))
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return h.latency_stats(call_log(spark, d), HOURS).withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@query("latency_stats_approx", with_(*L, body="SELECT source, count(*) AS n FROM call_log WHERE duration > 0 GROUP BY source"))
def latency_stats_approx(spark: SparkSession, d: str) -> DataFrame:
    log = call_log(spark, d)
    got = h.latency_stats_approx(log).where(F.col("p")[0] <= F.col("p")[2])
    return got.join(log.where("duration > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source").select("source", "n")


@query("error_rate", with_(*L, body="""
SELECT a.source, a.n, errors, round(errors::DOUBLE / a.n, 6) AS error_rate, round(stale, 6) AS stale_rate FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE NOT success) AS errors FROM call_log GROUP BY source) a
JOIN (SELECT source, e::DOUBLE / k AS stale FROM (SELECT source, success, row_number() OVER w AS k, sum((NOT success)::INT) OVER w AS e, ts, id FROM call_log WINDOW w AS (PARTITION BY source ORDER BY ts, id)) WHERE NOT success QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) = 1) USING (source)"""))
def error_rate(spark: SparkSession, d: str) -> DataFrame:
    log = call_log(spark, d)
    stale = h.error_rates(log, stale=True).select("source", F.round("error_rate", 6).alias("stale_rate"))
    return h.error_rates(log).withColumn("error_rate", F.round("error_rate", 6)).join(stale, "source")


KIND = "CASE WHEN status_code IN (401, 403) THEN 'auth' WHEN status_code = 404 THEN 'not_found' WHEN status_code = 429 THEN 'rate_limit' WHEN status_code >= 500 THEN 'server' WHEN error_code = 'ECONNABORTED' THEN 'timeout' WHEN error_code IN ('ENOTFOUND', 'ECONNREFUSED') THEN 'network' ELSE 'unknown' END"


@query("error_categorize", with_(*L, body=f"SELECT id, kind, kind IN ('timeout', 'network', 'server', 'rate_limit') AS retryable FROM (SELECT id, {KIND} AS kind FROM call_log WHERE NOT success)"))
def error_categorize(spark: SparkSession, d: str) -> DataFrame:
    return call_log(spark, d).where("NOT success").select("id", h.error_type().alias("kind")).withColumn("retryable", h.retryable(F.col("kind")))


@query("error_type_counts", with_(*L, body=f"SELECT source, {KIND} AS kind, count(*) AS n, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM call_log) - INTERVAL 24 HOUR) AS n_recent FROM call_log WHERE NOT success GROUP BY ALL"))
def error_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Failures by type, of all time and of the last day; recent_errors lists the latter."""
    log = call_log(spark, d)
    kinds = lambda rows, n: rows.where("NOT success").groupBy("source", h.error_type().alias("kind")).agg(F.count(F.lit(1)).alias(n))
    return kinds(log, "n").join(kinds(h.recent(log, HOURS), "n_recent"), ["source", "kind"], "left").withColumn("n_recent", F.coalesce("n_recent", F.lit(0)))


@query("recent_errors", with_(*L, RECENT, body=f"SELECT source, id, ts, kind, status_code, kind IN ('timeout', 'network', 'server', 'rate_limit') AS retryable FROM (SELECT *, {KIND} AS kind FROM recent WHERE NOT success)"))
def recent_errors(spark: SparkSession, d: str) -> DataFrame:
    return h.recent_errors(call_log(spark, d), HOURS)


STREAK = "streak AS (SELECT source, count(*) FILTER (WHERE NOT success AND (last IS NULL OR (ts, id) > last)) AS streak FROM call_log LEFT JOIN (SELECT source, max((ts, id)) AS last FROM call_log WHERE success GROUP BY source) USING (source) GROUP BY source)"


@query("consecutive_failures", with_(*L, STREAK, body="SELECT source, streak FROM streak"))
def consecutive_failures(spark: SparkSession, d: str) -> DataFrame:
    return h.streaks(call_log(spark, d))


WALK = """
w1 AS (SELECT *, sum(CASE WHEN success THEN -1 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts, id) AS s FROM call_log),
w2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY source ORDER BY ts, id)) AS c FROM w1)"""


@query("breaker_first_opening", with_(*L, WALK, body="SELECT source, id AS opened_id, ts AS opened_ts FROM w2 WHERE NOT success AND c >= 3 QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts, id) = 1"))
def breaker_first_opening(spark: SparkSession, d: str) -> DataFrame:
    return h.first_opening(call_log(spark, d), 3)


#: The breaker as a recursion over each source's calls of the last seven days.
BREAKER = """
calls AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, id) AS k FROM call_log WHERE ts > (SELECT max(ts) FROM call_log) - INTERVAL 168 HOUR),
fold AS (SELECT source, 0::BIGINT AS k, 'closed' AS state, 0 AS failures, 0 AS wins, NULL::TIMESTAMP AS retry, 0 AS opened FROM (SELECT DISTINCT source FROM calls)
  UNION ALL
  SELECT source, k, CASE WHEN state1 = 'open' AND ts >= retry1 THEN 'half-open' ELSE state1 END, failures1, wins1, CASE WHEN state1 = 'open' AND ts >= retry1 THEN NULL ELSE retry1 END, opened1
  FROM (SELECT c.source, c.k, c.ts,
      CASE WHEN success AND state = 'half-open' AND wins + 1 >= 3 THEN 'closed' WHEN NOT success AND ((state = 'closed' AND failures + 1 >= LIMIT_) OR state = 'half-open') THEN 'open' ELSE state END AS state1,
      CASE WHEN success AND state = 'half-open' AND wins + 1 >= 3 THEN 0 WHEN success AND state = 'closed' THEN greatest(0, failures - 1) WHEN success THEN failures ELSE failures + 1 END AS failures1,
      CASE WHEN NOT success OR (state = 'half-open' AND wins + 1 >= 3) THEN 0 WHEN state = 'half-open' THEN wins + 1 ELSE wins END AS wins1,
      CASE WHEN NOT success AND ((state = 'closed' AND failures + 1 >= LIMIT_) OR state = 'half-open') THEN ts + INTERVAL 60 SECOND ELSE retry END AS retry1,
      opened + (NOT success AND ((state = 'closed' AND failures + 1 >= LIMIT_) OR state = 'half-open'))::INT AS opened1
    FROM fold f JOIN calls c ON c.source = f.source AND c.k = f.k + 1)),
breaker AS (SELECT source, state, failures, opened FROM fold QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC) = 1)"""


def _breaker(limit: int) -> str:
    return BREAKER.replace("LIMIT_", str(limit))


@query("breaker_state", with_(*L, _breaker(3), body="SELECT source, state, failures, opened FROM breaker").replace("WITH ", "WITH RECURSIVE ", 1))
def breaker_state(spark: SparkSession, d: str) -> DataFrame:
    return h.breaker_state(call_log(spark, d), threshold=3)


SCORES = f"""
{_breaker(h.FAILURES).strip()},
scores AS (SELECT *, greatest(0, least(100, CASE WHEN state = 'open' THEN 0 WHEN state = 'half-open' THEN raw * 0.5::DOUBLE ELSE raw END)) AS score FROM (
  SELECT source, state, streak, error_rate, 100 - 50 * error_rate - least(40, 10 * streak) AS raw FROM breaker JOIN streak USING (source) JOIN (SELECT source, avg((NOT success)::INT::DOUBLE) AS error_rate FROM call_log GROUP BY source) USING (source)))"""
S = (CALL_LOG, STREAK, SCORES)
STATUS = "CASE WHEN state = 'open' THEN 'down' WHEN score <= 20 THEN 'critical' WHEN score < 60 THEN 'degraded' ELSE 'healthy' END"


def scored(body: str) -> str:
    return with_(*S, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("health_score", scored("SELECT source, round(score, 6) AS score, score > 20 AS operational FROM scores"))
def health_score(spark: SparkSession, d: str) -> DataFrame:
    return h.health_scores(call_log(spark, d)).select("source", F.round("score", 6).alias("score"), "operational")


@query("source_status", scored(f"SELECT source, {STATUS} AS status FROM scores"))
def source_status(spark: SparkSession, d: str) -> DataFrame:
    return h.health_scores(call_log(spark, d)).select("source", h.source_status().alias("status"))


@query("system_health", scored("""
SELECT round(overall, 6) AS overall, n_sources, n_healthy, n_requests, round(success_rate, 6) AS success_rate, round(mean_ms, 6) AS mean_ms,
  CASE WHEN n_healthy = 0 THEN 'down' WHEN overall < 30 THEN 'critical' WHEN overall < 60 OR n_healthy < n_sources * 0.5 THEN 'degraded' ELSE 'healthy' END AS status, n_healthy >= 1 AS operational
FROM (SELECT greatest(0, avg(score) - 5) AS overall, count(*) AS n_sources, count(*) FILTER (WHERE score > 20 AND state <> 'open') AS n_healthy FROM scores), (SELECT count(*) AS n_requests, avg(success::INT::DOUBLE) AS success_rate, sum(duration) / count(*) AS mean_ms FROM call_log)"""))
def system_health(spark: SparkSession, d: str) -> DataFrame:
    got = h.system_health(call_log(spark, d), 5.0)
    return got.select(F.round("overall", 6).alias("overall"), "n_sources", "n_healthy", "n_requests", F.round("success_rate", 6).alias("success_rate"), F.round("mean_ms", 6).alias("mean_ms"), "status", "operational")


@query("degraded_mode", scored("""
SELECT array_to_string(list_filter([CASE WHEN ok < 1 THEN 'few healthy sources' END, CASE WHEN e > 0.1 THEN 'high error rate' END, CASE WHEN ms > 50 THEN 'slow responses' END], lambda x: x IS NOT NULL), '; ') AS reasons, coalesce(disabled, '') AS disabled, ok < 1 OR e > 0.1 OR ms > 50 AS recommended
FROM (SELECT count(*) FILTER (WHERE score > 20) AS ok, string_agg(source, ',' ORDER BY source) FILTER (WHERE score <= 20) AS disabled FROM scores), (SELECT avg((NOT success)::INT::DOUBLE) AS e, sum(duration) / count(*) AS ms FROM call_log)"""))
def degraded_mode(spark: SparkSession, d: str) -> DataFrame:
    got = h.degraded_mode(call_log(spark, d), error_rate=0.1, slow_ms=50.0)
    return got.select(F.array_join("reasons", "; ").alias("reasons"), F.array_join("disabled", ",").alias("disabled"), "recommended")


@query("source_alerts", scored("""
SELECT source, 'error_rate' AS type, 'warning' AS level, round(error_rate, 6) AS value, 3 AS n_actions FROM scores WHERE error_rate > 0.1
UNION ALL SELECT source, 'consecutive_failures', 'error', streak::DOUBLE, 3 FROM scores WHERE streak >= 3 UNION ALL SELECT source, 'circuit_breaker', 'critical', 1.0::DOUBLE, 3 FROM scores WHERE state = 'open'"""))
def source_alerts(spark: SparkSession, d: str) -> DataFrame:
    got = h.with_actions(h.source_alerts(h.health_scores(call_log(spark, d)), 0.1))
    return got.select("source", "type", "level", F.round("value", 6).alias("value"), F.size("actions").alias("n_actions"))


ALERTS = f"alerts AS (SELECT source, {KIND} AS type, CASE WHEN duration > 100 THEN 'critical' WHEN duration > 50 THEN 'error' WHEN duration > 10 THEN 'warning' ELSE 'info' END AS level, ts, id FROM call_log WHERE NOT success)"
RANK = "CASE level WHEN 'critical' THEN 3 WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"


def alerts(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("duration") > 100, "critical").when(F.col("duration") > 50, "error").when(F.col("duration") > 10, "warning").otherwise("info")
    return call_log(spark, d).where("NOT success").select("source", h.error_type().alias("type"), level.alias("level"), "ts", "id")


@query("alert_merge", with_(*L, ALERTS, body=f"SELECT source, type, level, ts, first_ts, n FROM (SELECT *, min(ts) OVER w AS first_ts, count(*) OVER w AS n FROM alerts WINDOW w AS (PARTITION BY source, type)) QUALIFY row_number() OVER (PARTITION BY source, type ORDER BY {RANK} DESC, ts) = 1"))
def alert_merge(spark: SparkSession, d: str) -> DataFrame:
    return h.merge_alerts(alerts(spark, d))


#: The alert table after two runs, of the alerts before the middle of the log's time and of the others, and the resolution of the second.
ALERT_TABLE = """
middle AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS middle FROM call_log),
seen AS (SELECT source, max(ts) AS last_call FROM call_log GROUP BY source)"""


@query("alert_table", with_(*S, ALERTS, ALERT_TABLE, body=f"""
SELECT source, type, level, ts, first_ts, last_ts, n, NOT ok AS active, CASE WHEN ok THEN last_call END AS resolved_ts
FROM (SELECT *, min(ts) OVER w AS first_ts, max(ts) OVER w AS last_ts, count(*) OVER w AS n FROM alerts WINDOW w AS (PARTITION BY source, type) QUALIFY row_number() OVER (PARTITION BY source, type ORDER BY {RANK} DESC, ts) = 1)
JOIN (SELECT source, coalesce(score > 80 AND streak = 0, false) AS ok FROM scores) USING (source) JOIN seen USING (source)""").replace("WITH ", "WITH RECURSIVE ", 1))
def alert_table(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of two runs put into one table; sources have recovered or not at the end of the second."""
    path, log, rows = folder(spark, "alerts"), call_log(spark, d), alerts(spark, d)
    middle = log.agg(F.floor((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 2)).first()[0] or 0
    late = h.micros("ts") >= middle
    scores = h.health_scores(log).join(log.groupBy("source").agg(F.max("ts").alias("last_call")), "source")
    h.put_alerts(path, rows.where(~late), scores.withColumn("score", F.lit(0.0)), 1)
    h.put_alerts(path, rows.where(late), scores, 2)
    return newest(spark, path)


@query("alerts_dedupe", with_(*L, ALERTS, body=f"SELECT source, type, level FROM alerts QUALIFY row_number() OVER (PARTITION BY source, type ORDER BY {RANK} DESC, ts) = 1"))
def alerts_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return h.merge_alerts(alerts(spark, d)).select("source", "type", "level")


@query("alerts_by_severity", with_(*L, ALERTS, body=f"SELECT id, source, type, level FROM alerts WHERE {RANK} >= 2 ORDER BY {RANK} DESC, id"))
def alerts_by_severity(spark: SparkSession, d: str) -> DataFrame:
    rows = alerts(spark, d).where(h.level_rank("level") >= h.LEVELS["error"])
    return rows.select("id", "source", "type", "level").orderBy(h.level_rank("level").desc(), "id")


@query("alert_resolution", with_(*S, ALERTS, body="SELECT id, NOT coalesce(score > 80 AND streak = 0, false) AS active FROM alerts LEFT JOIN scores USING (source)").replace("WITH ", "WITH RECURSIVE ", 1))
def alert_resolution(spark: SparkSession, d: str) -> DataFrame:
    return h.resolve_alerts(alerts(spark, d), h.health_scores(call_log(spark, d))).select("id", "active")


POINTS = "points AS (SELECT ts, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (ORDER BY ts, id) AS total FROM call_log)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """Totals of conflicts over time: here the failures so far, in pieces, so that no window spans all rows."""
    log = call_log(spark, d).select("ts", "id", F.when(F.col("success"), 0).otherwise(1).alias("one"))
    return running(in_pieces(log, [], h.micros("ts"), F.col("id")), [], [F.col("ts"), F.col("id")], {"total": F.col("one")}).select("ts", "total")


TREND = """
last AS (SELECT arg_min(total, ts) AS a, arg_max(total, ts) AS b, min(ts) AS t0, max(ts) AS t1 FROM points WHERE ts > (SELECT max(ts) FROM points) - INTERVAL 1 HOUR),
trend AS (SELECT coalesce(CASE WHEN t1 > t0 THEN (b - a)::DOUBLE / ((epoch_us(t1) - epoch_us(t0)) / 3600000000.0::DOUBLE) END, 0) AS rate FROM last)"""


@query("conflict_trend", with_(*L, POINTS, TREND, body="SELECT round(rate, 6) AS rate, CASE WHEN rate > 10 THEN 'critical' WHEN rate > 5 THEN 'elevated' ELSE 'healthy' END AS status FROM trend"))
def conflict_trend(spark: SparkSession, d: str) -> DataFrame:
    return h.conflict_trend(points(spark, d)).select(F.round("rate", 6).alias("rate"), "status")


@query("conflict_penalty", with_(*L, POINTS, TREND, body="SELECT round(least(rate * 0.5::DOUBLE, 20), 6) AS penalty FROM trend"))
def conflict_penalty(spark: SparkSession, d: str) -> DataFrame:
    return h.conflict_trend(points(spark, d)).select(F.round("penalty", 6).alias("penalty"))


#: Failures so far at each quarter of an hour that has calls, their rates over the hour before, and the stretches of high ones.
PEAKS = """
quarters AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS ts, sum((NOT success)::INT) AS n FROM call_log GROUP BY 1),
totals AS (SELECT ts, sum(n) OVER (ORDER BY ts) AS total FROM quarters),
hourly AS (SELECT ts, total, first_value(total) OVER w AS a, epoch(ts - min(ts) OVER w) / 3600 AS passed FROM totals WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 3599 SECONDS PRECEDING AND CURRENT ROW)),
rates AS (SELECT ts, coalesce(last_value(CASE WHEN passed > 0 THEN (total - a)::DOUBLE / passed END IGNORE NULLS) OVER (ORDER BY ts), 0) AS rate FROM hourly),
islands AS (SELECT *, sum((rate <= 3)::INT) OVER (ORDER BY ts) AS island FROM rates),
peaks AS (SELECT min(ts) AS begin_ts, max(ts) AS end_ts, max(rate) AS rate, count(*) AS n_points FROM islands WHERE rate > 3 GROUP BY island ORDER BY begin_ts DESC LIMIT 10)"""
MOST_PER_HOUR = 2.0


def rates(spark: SparkSession, d: str) -> DataFrame:
    return h.conflict_rates(h.conflict_points(call_log(spark, d).select("ts", F.when(F.col("success"), 0).otherwise(1).alias("n"))))


@query("conflict_peaks", with_(*L, PEAKS, body="SELECT begin_ts, end_ts, round(rate, 6) AS rate, n_points FROM peaks"))
def conflict_peaks(spark: SparkSession, d: str) -> DataFrame:
    got = h.conflict_peaks(rates(spark, d), MOST_PER_HOUR)
    return got.select(F.col("begin_ts").cast("timestamp_ntz").alias("begin_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), F.round("rate", 6).alias("rate"), "n_points")


@query("conflict_alerts", with_(*ASSETS, CONFLICTS, CALL_LOG, PEAKS, body="""
, by_asset AS (SELECT asset_key, count(*) AS n FROM conflicts GROUP BY 1)
SELECT 'asset_conflict' AS type, asset_key AS subject, CASE WHEN n >= 4 THEN 'error' ELSE 'warning' END AS level, n::DOUBLE AS value FROM by_asset WHERE n >= 2
UNION ALL SELECT 'conflict_threshold', 'system', CASE WHEN v > 0.2 THEN 'error' ELSE 'warning' END, round(v, 6) FROM (SELECT (SELECT count(*) FROM by_asset)::DOUBLE / (SELECT count(DISTINCT asset_key) FROM keyed) AS v) WHERE v > 0.1
UNION ALL SELECT 'conflict_rate', 'system', 'warning', round(rate, 6) FROM (SELECT arg_max(rate, ts) AS rate FROM rates) WHERE rate > 2
UNION ALL SELECT 'conflict_peak', strftime(begin_ts, '%Y-%m-%d %H:%M'), 'info', round(rate, 6) FROM peaks"""))
def conflict_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows, hourly = keyed(spark, d), rates(spark, d)
    by_asset = merge.field_conflicts(rows, ["peg", "category", "website"]).groupBy("asset_key").agg(F.count(F.lit(1)).alias("n"))
    found = h.conflict_alerts(by_asset, rows.agg(F.countDistinct("asset_key").alias("n_assets")), 0.1, 2, hourly, MOST_PER_HOUR)
    peaks = h.conflict_peaks(hourly, MOST_PER_HOUR).select(F.lit("conflict_peak").alias("type"), F.date_format("begin_ts", "yyyy-MM-dd HH:mm").alias("subject"), F.lit("info").alias("level"), F.col("rate").alias("value"))
    return found.unionByName(peaks).withColumn("value", F.round("value", 6))


FRESH = "fresh AS (SELECT source, max(ts) AS last_ts, (epoch_us((SELECT max(ts) FROM call_log)) - epoch_us(max(ts))) / 1000000.0::DOUBLE AS age_s FROM call_log WHERE success GROUP BY source)"


@query("data_freshness", with_(*L, FRESH, body="SELECT source, last_ts, round(age_s, 6) AS age_s, age_s > 1800 AS stale, last_ts + INTERVAL 15 MINUTE AS next_ts FROM fresh"))
def data_freshness(spark: SparkSession, d: str) -> DataFrame:
    return h.freshness(call_log(spark, d)).withColumn("age_s", F.round("age_s", 6))


@query("health_overview", with_(*S, FRESH, body=f"SELECT source, {STATUS} AS status, {STATUS} <> 'down' AS healthy, CASE WHEN age_s > 1800 THEN 'Data is stale' ELSE '' END AS warnings FROM scores JOIN fresh USING (source)").replace("WITH ", "WITH RECURSIVE ", 1))
def health_overview(spark: SparkSession, d: str) -> DataFrame:
    log = call_log(spark, d)
    rows = h.health_scores(log).join(h.freshness(log).select("source", "stale"), "source").withColumn("status", h.source_status())
    return rows.select("source", "status", (F.col("status") != "down").alias("healthy"), F.when(F.col("stale"), "Data is stale").otherwise("").alias("warnings"))


@query("refresh_report", with_(*L, body="SELECT source, bool_or(success) AS success, sum(record_count) AS n_rows, count(*) FILTER (WHERE NOT success) AS errors FROM call_log GROUP BY source"))
def refresh_report(spark: SparkSession, d: str) -> DataFrame:
    return h.refresh_report(call_log(spark, d))


@query("recent_ops", with_(*L, body="SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) AS place FROM call_log QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) <= 1000"))
def recent_ops(spark: SparkSession, d: str) -> DataFrame:
    return h.recent_ops(call_log(spark, d)).select("source", "id", "place")


@query("retention", with_(*L, body="SELECT id FROM call_log WHERE ts > (SELECT max(ts) FROM call_log) - INTERVAL 168 HOUR"))
def retention(spark: SparkSession, d: str) -> DataFrame:
    return h.retained(call_log(spark, d)).select("id")
