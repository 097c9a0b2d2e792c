"""Tables in versions on plain folders: a version is written aside and comes in sight by one rename.

A version that is there already isn't written again, so a step that is repeated after a failure leaves one copy. Readers
take the newest version that is there when they begin.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a keyed table: what one changed key has to be written with.
BUCKETS = 64


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def local(self) -> str | None:
        """The path on a mounted file system; None in any other one."""
        uri = self._make(self.path).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def names(self) -> list[str]:
        at = self._make(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def has(self, name: str) -> bool:
        return self._fs.exists(self._make(f"{self.path}/{name}"))

    def remove(self, name: str) -> None:
        self._fs.delete(self._make(f"{self.path}/{name}"), True)

    def rename(self, old: str, new: str) -> bool:
        """False if new is there already."""
        if self.has(new):
            return False
        return self._fs.rename(self._make(f"{self.path}/{old}"), self._make(f"{self.path}/{new}"))


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(m[1]) for m in (re.fullmatch(r"version=(\d+)", n) for n in Folder(spark, path).names()) if m)


def publish(spark: SparkSession, path: str, number: int, write: Callable[[str], None]) -> bool:
    """Has write(folder) fill a new folder and puts it in sight as version number; False if that is there already."""
    folder = Folder(spark, path)
    if folder.has(f"version={number}"):
        return False
    aside = f".aside-{uuid.uuid4().hex}"
    try:
        write(f"{path}/{aside}")
        return folder.rename(aside, f"version={number}")
    finally:
        folder.remove(aside)


def newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the newest version; None if there is none."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def keep_versions(spark: SparkSession, path: str, n: int) -> None:
    """Deletes all versions but the newest n."""
    for number in versions(spark, path)[:-n]:
        Folder(spark, path).remove(f"version={number}")


class KeyedTable:
    """Rows by key that batches of rows are put into, and a table derived from them, kept up to date.

    Rows are told apart by key and part; of rows of one key and part the newest batch counts, and within it the last in
    the given order. derive makes rows of whole keys; it is run over the buckets with changed keys alone. A version is a list of which
    batch each bucket was last written by, so that publishing it is one rename, whatever it took to write. Keys aren't taken out.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, part: str, derive: Callable[[DataFrame], DataFrame], order: Column | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.part, self.derive, self.order, self.buckets = spark, path, key, part, derive, order, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def _batches(self) -> dict[int, int]:
        """Bucket -> the batch that wrote it last."""
        rows = newest(self.spark, f"{self.path}/versions")
        return {r.bucket: r.batch for r in rows.collect()} if rows is not None else {}

    def _read(self, name: str, batches: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/{name}/batch={n}/bucket={b}" for b, n in sorted(batches.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={number}")

    def put(self, rows: DataFrame, number: int) -> bool:
        """Adds a batch and publishes it as a version; False, and no change, if it is empty or was published before."""
        if number in versions(self.spark, f"{self.path}/versions"):
            return False
        columns, before = rows.columns, self._batches()
        self._write(rows, "landed", number)
        touched = [int(n.removeprefix("bucket=")) for n in Folder(self.spark, f"{self.path}/landed/batch={number}").names() if n.startswith("bucket=")]
        if not touched:
            return False
        new = self._read("landed", dict.fromkeys(touched, number)).select(*columns, F.lit(1).alias("_new"))
        old = self._read("rows", {b: n for b, n in before.items() if b in touched})
        both = new if old is None else old.select(*columns, F.lit(0).alias("_new")).unionByName(new)
        last = Window.partitionBy(self.key, self.part).orderBy(F.col("_new").desc(), *([self.order.desc()] if self.order is not None else []))
        self._write(both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new"), "rows", number)
        self._write(self.derive(self._read("rows", dict.fromkeys(touched, number))), "derived", number)
        now = self.spark.createDataFrame(sorted((before | dict.fromkeys(touched, number)).items()), "bucket int, batch long")
        return publish(self.spark, f"{self.path}/versions", number, lambda to: now.coalesce(1).write.parquet(to))

    def rows(self) -> DataFrame | None:
        return self._read("rows", self._batches())

    def derived(self) -> DataFrame | None:
        """The derived rows of all keys, of the newest version."""
        return self._read("derived", self._batches())
