"""Health of sources from the log of calls to them: latency, errors, breakers, scores, alerts.

A log has rows (id, source, ts, success, duration, record_count, status_code, error_code). "Now" is the newest ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetweave.operators.breaker import FAILURES, TIMEOUT_S, folded
from assetweave.operators.ordered import before, in_pieces, stored, values_at
from assetweave.sources.versions import newest, publish

ERROR_RATE, SLOW_MS, LEAST_HEALTHY = 0.3, 10_000.0, 1
LEVELS = {"info": 0, "warning": 1, "error": 2, "critical": 3}


def micros(ts: str) -> Column:
    """Microseconds of a timestamp, with or without a zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def level_rank(level: Column | str) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    return F.coalesce(*[F.when(c == k, v) for k, v in LEVELS.items()], F.lit(0))


def recent(log: DataFrame, hours: float) -> DataFrame:
    """Rows of the last hours before the newest."""
    now = F.broadcast(log.agg(F.max("ts").alias("now")))
    return log.join(now).where(F.col("ts") > F.col("now") - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {float(hours) * 3600})")).drop("now")


def latency_stats(log: DataFrame, hours: float = 1.0) -> DataFrame:
    """Per source: mean, median, p95, p99, least and most of the durations above 0. The p-th percentile is the
    element at index ceil(p / 100 * (n - 1))."""
    rows = recent(log, hours).where("duration > 0")
    last = F.col("n") - 1
    places = {"low": F.floor(last / 2), "high": F.ceil(last / 2), "p95": F.ceil(F.lit(0.95) * last), "p99": F.ceil(F.lit(0.99) * last)}
    found = values_at(rows, ["source"], "duration", places)
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean"), F.min("duration").alias("least"), F.max("duration").alias("most"))
    return sums.join(found, "source").select("source", "n", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "p99", "least", "most")


def latency_stats_approx(log: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """The same percentiles without ordering a source's calls, for sources with any number of them."""
    return log.where("duration > 0").groupBy("source").agg(F.percentile_approx("duration", [0.5, 0.95, 0.99], accuracy).alias("p"))


def error_rates(log: DataFrame, stale: bool = False) -> DataFrame:
    """Per source failures / requests; stale: as it stood at the last failure."""
    if not stale:
        return log.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("errors"), F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_rate"))
    last = log.where("NOT success").groupBy("source").agg(F.max(F.struct("ts", "id")).alias("last"))
    upto = log.join(last, "source").where(F.struct("ts", "id") <= F.col("last"))
    return upto.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("errors")).withColumn("error_rate", F.col("errors") / F.col("n"))


def error_type() -> Column:
    s, c = F.col("status_code"), F.col("error_code")
    return F.when(s.isin(401, 403), "auth").when(s == 404, "not_found").when(s == 429, "rate_limit").when(s >= 500, "server").when(c == "ECONNABORTED", "timeout").when(c.isin("ENOTFOUND", "ECONNREFUSED"), "network").otherwise("unknown")


def retryable(kind: Column) -> Column:
    return kind.isin("timeout", "network", "server", "rate_limit")


def streaks(log: DataFrame) -> DataFrame:
    """Per source the failures after its last success."""
    last = log.where("success").groupBy("source").agg(F.max(F.struct("ts", "id")).alias("last"))
    rows = log.join(last, "source", "left").where(F.col("last").isNull() | (F.struct("ts", "id") > F.col("last")))
    tail = rows.groupBy("source").agg(F.count_if(~F.col("success")).alias("streak"))
    return log.select("source").distinct().join(tail, "source", "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def first_opening(log: DataFrame, threshold: int = FAILURES) -> DataFrame:
    """Per source the call at which its breaker first opens, by windows over pieces of its calls.

    While closed, the failure count goes up by one and down by one, never under 0: a reflected walk, which is the
    plain walk less its least value so far.
    """
    rows = in_pieces(log.select("source", "ts", "id", "success"), ["source"], micros("ts"), F.col("id"))
    w = Window.partitionBy("source", "piece").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    walk = stored(rows.withColumn("s", F.sum(F.when(F.col("success"), -1).otherwise(1)).over(w)).withColumn("low", F.min("s").over(w)), "walk")
    sums = walk.groupBy("source", "piece").agg(F.sum(F.when(F.col("success"), -1).otherwise(1)).alias("total"), F.min("low").alias("low"))
    sums = before(sums, ["source"], "total", "start")
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "piece", "start", F.coalesce(F.min(F.col("start") + F.col("low")).over(earlier), F.lit(0)).alias("least"))
    placed = walk.join(sums, ["source", "piece"])
    count = F.col("start") + F.col("s") - F.least(F.lit(0), F.col("least"), F.col("start") + F.col("low"))
    opened = placed.where(~F.col("success") & (count >= threshold))
    return opened.groupBy("source").agg(F.min(F.struct("ts", "id")).alias("x")).select("source", F.col("x.ts").alias("opened_ts"), F.col("x.id").alias("opened_id"))


def breaker_state(log: DataFrame, days: float = 7.0, threshold: int = FAILURES, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """Per source the breaker after its calls of the retained days, in order: state, failure count and openings."""
    return folded(recent(log, 24 * days), threshold, timeout_s)


def health_scores(log: DataFrame) -> DataFrame:
    """Per source: error_rate, streak, mean duration, breaker state, score and whether it is operational."""
    mean = log.where("duration > 0").groupBy("source").agg(F.avg("duration").alias("mean_ms"))
    rows = error_rates(log).join(streaks(log), "source").join(breaker_state(log), "source").join(mean, "source", "left")
    raw = 100 - 50 * F.col("error_rate") - F.least(F.lit(40), 10 * F.col("streak")) - F.when(F.col("mean_ms") > SLOW_MS, 20).otherwise(0)
    score = F.when(F.col("state") == "open", 0.0).when(F.col("state") == "half-open", raw * 0.5).otherwise(raw)
    rows = rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    return rows.withColumn("operational", score > 20)


def source_status() -> Column:
    return F.when(F.col("state") == "open", "down").when(~F.col("operational"), "critical").when(F.col("score") < 60, "degraded").otherwise("healthy")


def system_health(log: DataFrame, conflict_penalty: float = 0.0) -> DataFrame:
    """One row over all sources."""
    s = health_scores(log).agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("operational") & (F.col("state") != "open")).alias("n_healthy"))
    calls = log.agg(F.count(F.lit(1)).alias("n_requests"), F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("success_rate"), (F.sum("duration") / F.count(F.lit(1))).alias("mean_ms"))
    rows = s.join(F.broadcast(calls)).withColumn("overall", F.greatest(F.lit(0.0), F.col("mean_score") - conflict_penalty))
    status = F.when(F.col("n_healthy") == 0, "down").when(F.col("overall") < 30, "critical").when((F.col("overall") < 60) | (F.col("n_healthy") < F.col("n_sources") * 0.5), "degraded").otherwise("healthy")
    return rows.withColumns({"status": status, "operational": F.col("n_healthy") >= LEAST_HEALTHY})


def degraded_mode(log: DataFrame, error_rate: float = ERROR_RATE, slow_ms: float = SLOW_MS, least: int = LEAST_HEALTHY) -> DataFrame:
    """One row: recommended, reasons, disabled sources."""
    s = health_scores(log).agg(F.count_if("operational").alias("n_ok"), F.array_sort(F.collect_list(F.when(~F.col("operational"), F.col("source")))).alias("disabled"))
    calls = log.agg(F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("e"), (F.sum("duration") / F.count(F.lit(1))).alias("ms"))
    reasons = F.array_compact(F.array(F.when(F.col("n_ok") < least, "few healthy sources"), F.when(F.col("e") > error_rate, "high error rate"), F.when(F.col("ms") > slow_ms, "slow responses")))
    return s.join(F.broadcast(calls)).select(reasons.alias("reasons"), "disabled").withColumn("recommended", F.size("reasons") > 0)


def source_alerts(scores: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """(source, type, level, value): rules that fire on the rows of health_scores."""
    rule = lambda kind, level, value, fired: F.struct(F.lit(kind).alias("type"), F.lit(level).alias("level"), value.cast("double").alias("value"), fired.alias("fired"))
    rules = F.array(rule("error_rate", "warning", F.col("error_rate"), F.col("error_rate") > error_rate), rule("consecutive_failures", "error", F.col("streak"), F.col("streak") >= 3), rule("circuit_breaker", "critical", F.lit(1), F.col("state") == "open"))
    return scores.select("source", F.explode(rules).alias("r")).where("r.fired").select("source", "r.type", "r.level", "r.value")


#: What to do about an alert.
ACTIONS = {
    "error_rate": ["Check API service status", "Verify network connectivity", "Review recent error messages"],
    "consecutive_failures": ["Check API credentials", "Verify API endpoints", "Check rate limiting status"],
    "circuit_breaker": ["Wait for circuit breaker timeout", "Check API service status", "Review error logs for root cause"],
    "conflict_rate": ["Review data source configurations", "Check for API schema changes", "Validate source priority settings", "Monitor data quality trends"],
    "conflict_threshold": ["Investigate specific conflicting assets", "Review field-level conflict patterns", "Check for systematic data quality issues", "Consider adjusting conflict resolution rules"],
}


def with_actions(alerts: DataFrame) -> DataFrame:
    dim = alerts.sparkSession.createDataFrame(list(ACTIONS.items()), "type string, actions array<string>")
    return alerts.join(F.broadcast(dim), "type", "left").withColumn("actions", F.coalesce("actions", F.array(F.lit("Review service logs"))))


def merge_alerts(alerts: DataFrame) -> DataFrame:
    """One per (source, type): the highest level, first on ties; first_ts is that of the first.

    alerts may be merged ones: rows with first_ts and n count as the alerts that they are made of.
    """
    first, n = (F.col(c) if c in alerts.columns else other for c, other in (("first_ts", F.col("ts")), ("n", F.lit(1).cast("long"))))
    best = F.max_by(F.struct("level", "ts"), F.struct(level_rank("level").alias("r"), (-micros("ts")).alias("t"))).alias("x")
    return alerts.groupBy("source", "type").agg(best, F.min(first).alias("first_ts"), F.sum(n).alias("n")).select("source", "type", "x.level", "x.ts", "first_ts", "n")


def put_alerts(path: str, alerts: DataFrame, scores: DataFrame, number: int) -> bool:
    """Puts a run's alerts (source, type, level, ts) into the table at path and publishes it as version number.

    The table has a row for each (source, type): level, ts, first_ts, last_ts, n, active and resolved_ts. An active alert
    is merged with those of the run; one that was resolved begins anew. Then the alerts of sources that have recovered are
    resolved, as of the source's newest call (scores: source, score, streak, last_call). False if the run was put before.
    """
    spark, key = alerts.sparkSession, ["source", "type"]
    last = alerts.groupBy(*key).agg(F.max("ts").alias("last_ts"))
    new = merge_alerts(alerts).join(last, key).withColumns({"active": F.lit(True), "resolved_ts": F.lit(None).cast(dict(alerts.dtypes)["ts"])})
    old = newest(spark, path)
    if old is not None:
        again = old.join(new.select(*key).withColumn("_again", F.lit(True)), key, "left")
        both = again.where("active OR _again IS NULL").drop("_again").select(*new.columns).unionByName(new)
        dates = both.groupBy(*key).agg(F.max("last_ts").alias("last_ts"), F.bool_or("active").alias("active"), F.max("resolved_ts").alias("resolved_ts"))
        new = merge_alerts(both).join(dates, key)
    ok = scores.select("source", ((F.col("score") > 80) & (F.col("streak") == 0)).alias("_ok"), "last_call")
    rows = new.join(ok, "source", "left").withColumn("_ends", F.col("active") & F.coalesce("_ok", F.lit(False)))
    rows = rows.withColumns({"active": F.col("active") & ~F.col("_ends"), "resolved_ts": F.when(F.col("_ends"), F.col("last_call")).otherwise(F.col("resolved_ts"))}).drop("_ok", "_ends", "last_call")
    return publish(spark, path, number, lambda to: rows.write.parquet(to))


def resolve_alerts(alerts: DataFrame, scores: DataFrame) -> DataFrame:
    """alerts with active: false where the source has recovered."""
    ok = scores.select("source", ((F.col("score") > 80) & (F.col("streak") == 0)).alias("ok"))
    return alerts.join(F.broadcast(ok), "source", "left").withColumn("active", ~F.coalesce("ok", F.lit(False))).drop("ok")


def conflict_trend(points: DataFrame, most_per_hour: float = 10.0) -> DataFrame:
    """One row of points (ts, total): conflicts per hour over the last hour, and what that means."""
    last = recent(points, 1.0).agg(F.min_by("total", "ts").alias("a"), F.max_by("total", "ts").alias("b"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    hours = (micros("t1") - micros("t0")) / 3.6e9
    rate = F.coalesce(F.when(hours > 0, (F.col("b") - F.col("a")) / F.nullif(hours, F.lit(0.0))), F.lit(0.0))
    rows = last.select(rate.alias("rate"))
    return rows.withColumns({"status": F.when(F.col("rate") > most_per_hour, "critical").when(F.col("rate") > most_per_hour * 0.5, "elevated").otherwise("healthy"), "penalty": F.least(F.col("rate") * 0.5, F.lit(20.0))})


def conflict_points(conflicts: DataFrame, minutes: int = 15) -> DataFrame:
    """(ts, total): conflicts so far at the end of each stretch of minutes that any of rows (ts, n) lies in."""
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * minutes)) * (60 * minutes)
    # stretches are as many as the time that the rows span has, however many the rows are
    sums = conflicts.groupBy(at.alias("at")).agg(F.sum("n").alias("n"))
    return sums.select(F.timestamp_seconds("at").alias("ts"), F.sum("n").over(Window.orderBy("at")).alias("total"))


def conflict_rates(points: DataFrame, hours: float = 1.0) -> DataFrame:
    """points (ts, total) with rate: conflicts an hour over the hours up to each; a point that is alone in them has the rate
    of the one before."""
    at = F.unix_seconds("ts")
    inside = Window.orderBy(at).rangeBetween(1 - int(hours * 3600), 0)
    passed = (at - F.min(at).over(inside)) / 3600
    now = F.when(passed > 0, (F.col("total") - F.first("total").over(inside)) / F.nullif(passed, F.lit(0.0)))
    rows = points.withColumn("_now", now)
    return rows.withColumn("rate", F.coalesce(F.last("_now", ignorenulls=True).over(Window.orderBy(at)), F.lit(0.0))).drop("_now")


def conflict_peaks(rates: DataFrame, most_per_hour: float, keep: int = 10) -> DataFrame:
    """(begin_ts, end_ts, rate, n_points): the last stretches of points whose rates are over 1.5 times the most, with the highest."""
    high = F.col("rate") > 1.5 * most_per_hour
    rows = rates.withColumn("_island", F.sum(F.when(high, 0).otherwise(1)).over(Window.orderBy("ts"))).where(high)
    found = rows.groupBy("_island").agg(F.min("ts").alias("begin_ts"), F.max("ts").alias("end_ts"), F.max("rate").alias("rate"), F.count(F.lit(1)).alias("n_points"))
    return found.drop("_island").orderBy(F.col("begin_ts").desc()).limit(keep)


def conflict_alerts(by_asset: DataFrame, n_assets: DataFrame, share: float, per_asset: int, rates: DataFrame | None = None, most_per_hour: float = 10.0) -> DataFrame:
    """(type, subject, level, value) from conflicts by asset (asset_key, n), the number of assets and the rates over time
    (conflict_rates), of which the newest counts."""
    each = by_asset.where(F.col("n") >= per_asset).select(F.lit("asset_conflict").alias("type"), F.col("asset_key").alias("subject"), F.when(F.col("n") >= 2 * per_asset, "error").otherwise("warning").alias("level"), F.col("n").cast("double").alias("value"))
    part = by_asset.agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n_assets)).select((F.col("c") / F.col("n_assets")).alias("value"))
    whole = part.where(F.col("value") > share).select(F.lit("conflict_threshold").alias("type"), F.lit("system").alias("subject"), F.when(F.col("value") > 2 * share, "error").otherwise("warning").alias("level"), "value")
    out = each.unionByName(whole)
    if rates is None:
        return out
    now = rates.agg(F.max_by("rate", "ts").alias("value")).where(F.col("value") > most_per_hour)
    return out.unionByName(now.select(F.lit("conflict_rate").alias("type"), F.lit("system").alias("subject"), F.lit("warning").alias("level"), "value"))


def recent_errors(log: DataFrame, hours: float = 24.0) -> DataFrame:
    """The failures of the last hours: source, id, ts, kind, status_code, retryable."""
    rows = recent(log, hours).where("NOT success").withColumn("kind", error_type())
    return rows.select("source", "id", "ts", "kind", "status_code", retryable(F.col("kind")).alias("retryable"))


def freshness(log: DataFrame, interval_min: int = 15) -> DataFrame:
    """Per source: age in seconds of its last success, whether it is stale, when it is due next."""
    now = F.broadcast(log.agg(F.max("ts").alias("now")))
    rows = log.where("success").groupBy("source").agg(F.max("ts").alias("last_ts")).join(now)
    age = (micros("now") - micros("last_ts")) / 1e6
    return rows.select("source", "last_ts", age.alias("age_s"), (age > 2 * 60 * interval_min).alias("stale"), (F.col("last_ts") + F.expr(f"INTERVAL {interval_min} MINUTES")).alias("next_ts"))


def refresh_report(log: DataFrame) -> DataFrame:
    return log.groupBy("source").agg(F.bool_or("success").alias("success"), F.sum("record_count").alias("n_rows"), F.count_if(~F.col("success")).alias("errors"))


def recent_ops(log: DataFrame, keep: int = 1000) -> DataFrame:
    """The newest calls of each source."""
    w = Window.partitionBy("source").orderBy(F.col("ts").desc(), F.col("id").desc())
    return log.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def retained(rows: DataFrame, days: float = 7.0) -> DataFrame:
    return recent(rows, 24 * days)
