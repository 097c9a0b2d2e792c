"""Exact dedup of texts against immutable snapshots, each screened by static binary-fuse filters.

Texts are equal when they are identical without the characters of SPACES. Documents come in batches. The copies within a
batch are grouped by themselves, by the SHA-256 of the text without white space, which gives the batch's distinct texts. Their digests are
screened by the filters of all snapshots, shard by shard; digests that pass a filter join the buckets of that snapshot and
their texts are compared, byte by byte. Texts found so belong to the older group; all others are new. The batch's
distinct texts then are a snapshot of their own, stored in buckets of the digest, sorted, with a filter for each shard of
the digests that it was the first to have. Snapshots and filters are never changed.

Of a group the row with the most code points stays, then the one with the least doc_id.

Defined cases: a null text counts as empty, and empty texts are a group; a null doc_id comes after all others, and its rows are in
the first batch; of rows that agree in doc_id, text without white space and length one stays, any of them; texts of one
SHA-256 and different other hashes raise an error; an empty table gives no rows; copy_groups reads doc_id and text alone,
keep_one passes all columns through whatever their names.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.llm import fusefilter
from assetweave.llm.common import cut_points, joined_by_size, partitions, remove, remove_path, scratch, unused, written
from assetweave.llm.linededup import sorted_scans

SPACES = " \t\n\x0b\x0c\r"
BATCHES = 4
#: Digests of one filter, about: what a task holds of a snapshot, 8 bytes a digest.
SHARD_KEYS = 500_000

FILTERS = "snapshot int, shard int, seed long, segment int, segments int, held binary"


def bare(text: Column) -> Column:
    """The text without white space."""
    # one after another: translate() looks every character up in a table of texts
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(bare(text), 256))


def chars(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


class Snapshot:
    """The distinct texts of a batch (sha, body, n, best) in buckets of sha, and the older groups that some belong to."""

    def __init__(self, spark: SparkSession, number: int, groups: DataFrame, buckets: int):
        self.spark, self.number, self.path = spark, number, scratch(spark, "copies")
        self.name = "copies_" + self.path[-32:]
        groups.write.format("parquet").bucketBy(buckets, "sha").sortBy("sha").option("path", self.path).saveAsTable(self.name)
        self.schema = self.rows().schema
        self.known: DataFrame | None = None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def members(self) -> DataFrame:
        """(sha, owner, n, best): owner is the number of the snapshot that had the text first."""
        rows = self.spark.read.schema(self.schema).parquet(self.path).select("sha", "n", "best")
        if self.known is None:
            return rows.select("sha", F.lit(self.number).alias("owner"), "n", "best")
        return rows.join(self.known, "sha", "left").select("sha", F.coalesce("owner", F.lit(self.number)).alias("owner"), "n", "best")

    def remove(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        remove_path(self.spark, self.path)
        if self.known is not None:
            remove(self.spark, self.known)


class Snapshots:
    """Snapshots in the order of their batches, with their filters. shards: parts of the digests, each with a filter of its own."""

    def __init__(self, spark: SparkSession, shards: int):
        self.spark, self.shards, self.buckets = spark, shards, partitions(spark)
        self.found: list[Snapshot] = []
        self.filters: list[DataFrame] = []

    def _keys(self, rows: DataFrame) -> DataFrame:
        key = F.xxhash64("sha")
        return rows.select("sha", key.alias("key"), F.pmod(F.hash(key), F.lit(self.shards)).alias("shard"))

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Adds a batch: groups its copies, looks its distinct texts up in the snapshots and stores them as one more."""
        rows = docs.select(F.col("doc_id"), chars(F.col(text)).alias("size"), bare(F.col(text)).alias("body"))
        rows = rows.select(F.unhex(F.sha2("body", 256)).alias("sha"), "body", F.xxhash64("body").alias("other"), F.struct("size", (-F.col("doc_id")).alias("minus_id")).alias("place"))
        one = F.when(F.min("other") == F.max("other"), F.first("body")).otherwise(F.raise_error(F.lit("two texts have one SHA-256")).cast("string"))
        groups = rows.groupBy("sha").agg(one.alias("body"), F.count(F.lit(1)).alias("n"), F.max("place").alias("best"))
        with sorted_scans(self.spark):
            snapshot = Snapshot(self.spark, len(self.found), groups, self.buckets)
            try:
                if self.found:
                    snapshot.known = self._known(snapshot)
            finally:
                self.found.append(snapshot)
            self.filters.append(self._filters(snapshot))

    def _filters(self, snapshot: Snapshot) -> DataFrame:
        """A filter for each shard of the digests that the snapshot was the first to have."""
        number = snapshot.number

        def build(t: pa.Table) -> pa.Table:
            seed, segment, segments, held = fusefilter.build(t["key"].to_numpy())
            shard = t["shard"][0].as_py()
            return pa.table({"snapshot": pa.array([number], pa.int32()), "shard": pa.array([shard], pa.int32()), "seed": pa.array([seed], pa.int64()), "segment": pa.array([segment], pa.int32()), "segments": pa.array([segments], pa.int32()), "held": pa.array([held], pa.binary())})

        new = snapshot.members().where(F.col("owner") == number).select("sha")
        return written(self._keys(new).select("key", "shard").groupBy("shard").applyInArrow(build, FILTERS), "filters")

    def screened(self, rows: DataFrame) -> DataFrame:
        """(sha, snapshot) for the digests of rows that pass the snapshot's filter of their shard."""

        def screen(keys: pa.Table, filters: pa.Table) -> pa.Table:
            parts = []
            for f in filters.to_pylist():
                passed = fusefilter.holds(keys["key"].to_numpy(), f["seed"], f["segment"], f["segments"], f["held"])
                sha = keys["sha"].filter(pa.array(passed)).combine_chunks()
                parts.append(pa.table({"sha": sha, "snapshot": pa.array([f["snapshot"]] * len(sha), pa.int32())}))
            return pa.concat_tables(parts) if parts else pa.table({"sha": pa.array([], pa.binary()), "snapshot": pa.array([], pa.int32())})

        filters = reduce(DataFrame.union, self.filters)
        return self._keys(rows).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(screen, "sha binary, snapshot int")

    def _known(self, snapshot: Snapshot) -> DataFrame:
        """(sha, owner) of the snapshot's texts that an older one holds, compared byte by byte in the buckets of both."""
        passed = written(self.screened(snapshot.rows().select("sha")), "passed")
        same = []
        for old in self.found:
            held = old.rows().select(F.col("sha").alias("held_sha"), F.col("body").alias("held_body")).hint("merge")
            mine = snapshot.rows().select("sha", "body").join(passed.where(F.col("snapshot") == old.number).select("sha"), "sha")
            # not an equality of bodies, as that would be a key of the join and bring all bodies out of their buckets
            bytes_alike = (F.col("body") >= F.col("held_body")) & (F.col("body") <= F.col("held_body"))
            same.append(mine.join(held, (F.col("sha") == F.col("held_sha")) & bytes_alike).select("sha", F.lit(old.number).alias("owner")))
        # a text that two snapshots hold belongs to the older one
        out = written(reduce(DataFrame.union, same).groupBy("sha").agg(F.min("owner").alias("owner")), "known")
        remove(self.spark, passed)
        return out

    def groups(self) -> DataFrame:
        """(sha, keep_id, keep_size, group_size) for each distinct text of all batches."""
        members = reduce(DataFrame.union, [s.members() for s in self.found])
        whole = members.groupBy("sha", "owner").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
        return whole.select("sha", (-F.col("best.minus_id")).alias("keep_id"), F.col("best.size").alias("keep_size"), "group_size")

    def remove(self) -> None:
        """Deletes all snapshots and filters."""
        for s in self.found:
            s.remove()
        for f in self.filters:
            remove(self.spark, f)
        self.found, self.filters = [], []


def grouped(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The groups of all texts of docs (doc_id, text), which are fed to new snapshots in batches of doc_id ranges."""
    spark, n = docs.sparkSession, docs.count()
    store = Snapshots(spark, max(partitions(spark), -(-n // SHARD_KEYS)))
    cuts = cut_points(docs, "doc_id", batches)
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            where = F.lit(True)
            if low is not None:
                where &= F.col("doc_id") >= low
            if high is not None:
                where &= F.col("doc_id") < high
            store.add(docs.where(where | F.col("doc_id").isNull() if low is None else where))
        return written(store.groups(), "copy-groups")
    finally:
        store.remove()


def copy_groups(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept and text_sha256, of the text without white space."""
    docs = docs.select("doc_id", "text")
    groups = grouped(docs, batches)
    # rows alike are counted, so that one of them stays; written, as the join reads them twice
    rows = docs.select("doc_id", digest(F.col("text")).alias("sha"), chars(F.col("text")).alias("size")).groupBy("sha", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    found = joined_by_size(written(rows, "digests"), groups, ["sha"], "group_size")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size"))
    found = found.select("doc_id", "keep_id", "group_size", best.alias("best"), "sha", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns."""
    own, sha, size = unused(docs, "own", "sha", "size")
    stay = grouped(docs.select("doc_id", "text"), batches).select(F.col("sha").alias(sha), F.col("keep_id").alias(own), F.col("keep_size").alias(size))
    keyed = docs.withColumns({sha: digest(F.col("text")), size: chars(F.col("text"))})
    same = (keyed[sha] == stay[sha]) & keyed["doc_id"].eqNullSafe(stay[own]) & (keyed[size] == stay[size])
    return keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", sha, size]).select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS body FROM documents),
r AS (SELECT doc_id, body, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d WINDOW w AS (PARTITION BY body ORDER BY size DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM r
"""
