"""Tables in versions, the sinks on them and the refresh that is put up batch by batch."""

from pyspark.sql import functions as F

from assetweave.operators import health, merge
from assetweave.plans.assets import keyed
from assetweave.sources import snapshots as sn
from assetweave.sources.versions import Folder, KeyedTable, keep_versions, newest, publish, versions
from tests.oracle import DATA


def test_a_version_is_published_once(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(3)
    assert newest(spark, path) is None
    assert publish(spark, path, 1, lambda to: rows.write.parquet(to))
    assert not publish(spark, path, 1, lambda to: spark.range(9).write.parquet(to))
    assert publish(spark, path, 12, lambda to: spark.range(5).write.parquet(to))
    assert newest(spark, path).count() == 5 and versions(spark, path) == [1, 12]
    keep_versions(spark, path, 1)
    assert Folder(spark, path).names() == ["version=12"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")

    def fails(to):
        spark.range(3).write.parquet(to)
        raise OSError("lost")

    try:
        publish(spark, path, 1, fails)
    except OSError:
        pass
    assert Folder(spark, path).names() == [] and newest(spark, path) is None
    assert publish(spark, path, 1, lambda to: spark.range(3).write.parquet(to)) and newest(spark, path).count() == 3


def merged(rows):
    return merge.merge_assets(rows).select("asset_key", "price", "mcap", "mcap_source", "sources")


def test_batches_end_in_the_merge_of_all(spark, tmp_path):
    rows = keyed(spark, DATA).withColumn("part", F.concat_ws(":", "source", "key")).cache()
    table = KeyedTable(spark, str(tmp_path / "assets"), "asset_key", "part", merged, buckets=4)
    for number, source in enumerate(["defillama", "cmc", "coingecko", "messari"]):
        assert table.put(rows.where(F.col("source") == source), number)
    wanted = sorted(map(str, merged(rows).collect()))
    assert sorted(map(str, table.derived().select("asset_key", "price", "mcap", "mcap_source", "sources").collect())) == wanted
    # an empty batch, and one that comes again, leave the version
    assert not table.put(rows.limit(0), 9) and not table.put(rows.where("source = 'cmc'").withColumn("price", F.lit(1.0)), 1)
    assert versions(spark, f"{table.path}/versions") == [0, 1, 2, 3]
    # a row that changes is merged again, in its bucket alone
    one = rows.where("source = 'cmc'").orderBy("asset_key").limit(1).withColumn("mcap", F.lit(12345.0))
    before = {n: t for n, t in table._batches().items()}
    assert table.put(one, 10)
    assert sum(n == 10 for n in table._batches().values()) == 1 and len(table._batches()) == len(before)
    key = one.first().asset_key
    assert table.derived().where(F.col("asset_key") == key).first().mcap == 12345.0
    assert table.derived().count() == len(wanted)


def test_a_batch_that_failed_halfway_is_put_again(spark, tmp_path):
    def broken(rows):
        raise OSError("lost")

    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "key string, part string, n int")
    total = lambda r: r.groupBy("key").agg(F.sum("n").alias("n"))
    KeyedTable(spark, str(tmp_path / "t"), "key", "part", total, buckets=2).put(rows, 0)
    table = KeyedTable(spark, str(tmp_path / "t"), "key", "part", broken, buckets=2)
    more = spark.createDataFrame([("a", "y", 10)], rows.schema)
    try:
        table.put(more, 1)
    except OSError:
        pass
    table.derive = total
    assert {tuple(r) for r in table.derived().select("key", "n").collect()} == {("a", 1), ("b", 2)}
    assert table.put(more, 1)
    assert {tuple(r) for r in table.derived().select("key", "n").collect()} == {("a", 11), ("b", 2)}


def test_sink_gold_shares_out_large_values(spark, tmp_path):
    path = str(tmp_path / "gold")
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "hot").when(F.col("id") < 990, F.concat(F.lit("p"), F.col("id") % 5)).alias("platform"), "id")
    assert sn.sink_gold(rows, path, "platform", 3, file_rows=100) and not sn.sink_gold(rows, path, "platform", 3, file_rows=100)
    got = newest(spark, path)
    assert got.count() == 1000 and got.where("platform IS NULL").count() == 10
    files = spark.read.parquet(f"{path}/version=3/platform=hot").withColumn("f", F.input_file_name()).groupBy("f").count().collect()
    assert len(files) >= 7 and max(r["count"] for r in files) <= 100
    assert sn.sink_gold_by_asset(rows.withColumn("asset", F.concat(F.lit("a"), F.col("id") % 40)), path + "-assets", "asset")
    assets = spark.read.parquet(path + "-assets/version=0").withColumn("f", F.input_file_name())
    assert assets.select("f").distinct().count() == 40 and assets.where("prefix <> substring(md5(asset), 1, 2)").count() == 0


def test_files_of_assets_are_written_and_read_without_spark_partitions(spark, tmp_path):
    """A file for each asset, whatever its name, and no more: no checksum file, each of which was a process or two more."""
    path, keys = str(tmp_path / "gold"), ["a", "a/b", "x=1", "50%", "007", "é ü", "", None]
    rows = spark.createDataFrame([(k, n, {"n": n}) for k in keys for n in range(3)], "asset string, n int, m map<string,int>")
    assert sn.sink_gold_by_asset(rows, path, "asset", 2) and not sn.sink_gold_by_asset(rows, path, "asset", 2)
    files = [f for f in (tmp_path / "gold" / "version=2").rglob("*") if f.is_file()]
    assert len(files) == 7 + 1 and all(f.match("prefix=*/asset=*/part-0.parquet") for f in files)
    got = sn.gold_by_asset(spark, path, "asset", rows.drop("asset").schema)
    # as in Spark's folders, an empty name is none
    assert sorted(map(str, got.select("asset", "n", "m").collect())) == sorted(map(str, rows.withColumn("asset", F.nullif("asset", F.lit(""))).collect()))
    assert got.where("asset IS NOT NULL AND prefix <> substring(md5(asset), 1, 2)").count() == 0
    assert {r.asset for r in spark.read.schema("asset string").parquet(path + "/version=2").collect()} == {*keys} - {""}
    # an asset over several batches; no rows at all
    many = spark.range(30_000).select(F.lit("hot").alias("asset"), "id")
    assert sn.sink_gold_by_asset(many, path + "-hot", "asset") and sn.gold_by_asset(spark, path + "-hot", "asset", many.drop("asset").schema).distinct().count() == 30_000
    assert sn.sink_gold_by_asset(many.limit(0), path + "-none", "asset") and sn.gold_by_asset(spark, path + "-none", "asset", many.drop("asset").schema).count() == 0


def test_sink_snapshot_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "bronze")
    rows = spark.range(10).select(F.lit("cmc").alias("source"), F.lit("t1").alias("snapshot_ts"), "id")
    for _ in range(2):
        assert sn.sink_snapshot(rows, path, F.col("id") > 6) == {"raw": 10, "eligible": 3}
    sn.sink_snapshot(rows.withColumn("snapshot_ts", F.lit("t2")), path)
    assert {(r.snapshot_ts, r["count"]) for r in spark.read.parquet(path).groupBy("snapshot_ts").count().collect()} == {("t1", 10), ("t2", 10)}


def test_alert_table_over_runs(spark, tmp_path):
    at = lambda rows: spark.createDataFrame(rows, "source string, type string, level string, t long").select("source", "type", "level", F.timestamp_seconds("t").alias("ts"))
    scores = lambda *rows: spark.createDataFrame(list(rows), "source string, score double, streak int, t long").select("source", "score", "streak", F.timestamp_seconds("t").alias("last_call"))
    first, second = [("a", "server", "warning", 10), ("a", "server", "error", 20), ("b", "auth", "info", 5)], [("a", "server", "error", 30), ("a", "auth", "info", 31), ("b", "auth", "critical", 32)]
    bad = scores(("a", 10.0, 3, 40), ("b", 10.0, 3, 40))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    assert health.put_alerts(one, at(first + second), bad, 1)
    assert health.put_alerts(two, at(first), bad, 1) and health.put_alerts(two, at(second), bad, 2) and not health.put_alerts(two, at(second), bad, 2)
    rows = lambda path: sorted(map(str, newest(spark, path).select("source", "type", "level", "ts", "first_ts", "last_ts", "n", "active", "resolved_ts").collect()))
    assert rows(one) == rows(two)
    # a recovers; its alert then begins anew
    health.put_alerts(two, at([]), scores(("a", 95.0, 0, 50), ("b", 10.0, 3, 50)), 3)
    assert {(r.source, r.type): r.active for r in newest(spark, two).collect()} == {("a", "server"): False, ("a", "auth"): False, ("b", "auth"): True}
    health.put_alerts(two, at([("a", "server", "info", 60)]), bad, 4)
    again = newest(spark, two).where("source = 'a' AND type = 'server'").first()
    assert (again.level, again.n, again.active, again.resolved_ts, again.first_ts) == ("info", 1, True, None, again.ts)
